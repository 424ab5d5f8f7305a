import numpy as np
import pytest

from fairlead.llm import toxicity
from fairlead.llm.catalog import QUERIES
from tests.llm.helpers import SF_BIG, WORDS, documents, odd_documents


@pytest.fixture(scope="module")
def restorer(spark):
    docs = documents(spark, [(i, " ".join(WORDS) + " idiot moron scum a stupid idiot clown") for i in range(50)])
    return toxicity.Restorer(toxicity.letter_model(docs))


def test_disguises(restorer):
    for written in ("1d10t", "idi0t", "IDIOT!!", "i-d-i-o-t", "id!ot", "iiidddiiiooottt", "idiot"):
        assert "idiot" in restorer.readings(written), written
    assert "scum" in restorer.readings("$cum") and "moron" in restorer.readings("m0r0n,")
    assert restorer.readings("1234") == () and restorer.readings("--") == ()
    assert "".join(restorer.restore("x" * 3000))[0] == "x"
    assert "i d i o t" in toxicity.tokens_of("you i d i o t there") and "idiot" in restorer.readings("i d i o t")


def test_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF_BIG}/labels.parquet").select("doc_id", "toxic")
    rows = QUERIES["op9_toxicity"](spark, SF_BIG).join(labels, "doc_id").where("held_out").collect()
    toxic = np.array([r["toxic"] == 1 for r in rows])
    said = np.array([r["predicted"] == 1 for r in rows])
    assert said[toxic].mean() > 0.85 and said[~toxic].mean() < 0.05


def test_odd_rows(spark):
    docs = documents(spark, odd_documents())
    labels = spark.createDataFrame([(1, 0), (2, 0), (7, 1), (7, 1), (9, None), (None, 1), (8, 5)], "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.learn_from(docs, labels)).collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert len({r["score"] for r in scored if r["doc_id"] in (3, 4, 5)}) == 1
    for some in (labels.where("toxic = 0"), labels.limit(0)):
        assert {r["score"] > 0.3 for r in toxicity.score(docs, toxicity.learn_from(docs, some)).collect()} <= {False, True}
    assert toxicity.score(docs.limit(0), toxicity.learn_from(docs.limit(0), labels)).count() == 0


def test_signs_at_the_ends_tokens_without_letters_and_spelled_words(spark):
    docs = documents(spark, [(i, " ".join(WORDS) + " a stupid ass and a dumbass and an ass, shit and you stupid ass") for i in range(50)])
    restorer = toxicity.Restorer(toxicity.letter_model(docs))
    for written, word in (("a$$", "ass"), ("dumba$$", "dumbass"), ("a$$!!", "ass"), ("*ss", "ass"), ("455", "ass"), ("5#1+", "shit"), ("a s t u p i d", "stupid"), ("y o u s t u p i d", "stupid")):
        assert word in restorer.readings(written), (written, restorer.readings(written))
    assert "stupid" in restorer.readings("stupid!!") and restorer.readings("stupid") == ("stupid",)
    for written in ("1234", "777", "--", "!!!", "***", ""):
        assert restorer.readings(written) == (), written


def test_readers_that_skip_lattices_find_what_all_readings_have(restorer):
    rng = np.random.default_rng(11)
    words = ["idiot", "moron", "scum", "stupid", "clown", "ass", "shit", "aas", "iddio", "i", "as", *WORDS[:20]]
    letters = [*"aabiimnoostu", *toxicity.SIGNS, *"?,;ß²É%"]
    tokens = [w + end for w in words for end in ("", ".", "$$$", "***", "!!", "%%%", "1")]
    for _ in range(3000):
        word = [*words[rng.integers(len(words))]]
        for _ in range(rng.integers(1, 5)):
            word[rng.integers(len(word))] = letters[rng.integers(len(letters))] * int(rng.integers(1, 4))
        tokens.append("".join(word))
    tokens = [t for t in dict.fromkeys(tokens) if t]
    kept = {f for w in words[:11] for f in toxicity.features_of(w)} - {"idi", "stu", "stup", "=clown"}
    found = toxicity._readers(restorer, kept, 10).lookup(tokens)
    for token in tokens:
        assert set(found(token)) == {f for r in restorer.readings(token) for f in toxicity.features_of(r)} & kept, token


def test_rows_of_both_labels_reach_the_fit_until_its_end(spark):
    rng = np.random.default_rng(5)
    common = [a + b + c for a in "bcdfg" for b in "aeiouy" for c in "mn"]
    insults = [a + b + c + d for a in "kpqx" for b in "aeiou" for c in "rstv" for d in "ly"][:40]
    rows = []
    for i in range(6000):
        toxic = i % 20 == 0
        words = [w for w in common if rng.random() < (0.9 if toxic else 0.7)]
        rows.append((i, " ".join([*words, insults[rng.integers(40)]] if toxic else words)))
    docs, labels = documents(spark, rows), spark.createDataFrame([(i, int(i % 20 == 0)) for i, _ in rows], "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.learn_from(docs, labels, sample=300)).collect()
    said, toxic = np.array([r["score"] >= 0.3 for r in scored]), np.array([r["doc_id"] % 20 == 0 for r in scored])
    assert said[toxic].mean() > 0.85 and said[~toxic].mean() < 0.05, (said[toxic].mean(), said[~toxic].mean())
