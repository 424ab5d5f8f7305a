"""Named queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.llm import byte_bpe, fingerprints, hard_negatives, host_reputation, inner_topk, jaccard, language, main_text, packing, piece_bpe, repeats, toxicity, whitening
from fairlead.llm.common import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql:
            ORACLE[name] = sql
        return build

    return register


@query(
    "op1_inner_topk",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS nth FROM s)
    SELECT query_id, CAST(nth AS INTEGER) AS rank, vec_id, score FROM r WHERE nth <= 10
    """,
)
def op1_inner_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").where(F.col("vec_id").isNotNull() & inner_topk.usable(F.col("embedding")))
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), inner_topk.whole_steps(F.col("embedding"), 1024).alias("v"))
    queries = vectors.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return inner_topk.search(vectors, queries, 10)


RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def _reputation_sql() -> str:
    """The same posterior, level by level."""

    def level(name: str, children: str, prior: str, doubt: str, keys: str) -> str:
        return f"""
    {name}_c AS (SELECT {keys}, n, bad, {prior} AS prior, {doubt} AS doubt FROM {children}),
    {name}_m AS (
      SELECT sum(power(bad / n - prior, 2) - prior * (1 - prior) / n) FILTER (WHERE n > 0) AS spread,
        sum(prior * (1 - prior) * (1 - 1 / n)) FILTER (WHERE n > 0) AS most FROM {name}_c),
    {name}_s AS (SELECT round(CASE WHEN spread > 0 THEN greatest(1.0, least(1000.0, most / spread - 1)) ELSE 1000.0 END, 9) AS s FROM {name}_m),
    {name}_p AS (SELECT *, (bad + prior * s) / (n + s) AS mean, n + s AS total FROM {name}_c, {name}_s),
    {name} AS (SELECT *, mean * (1 - mean) / (total + 1) + power(s / total, 2) * doubt AS now_doubt FROM {name}_p)"""

    rules = ", ".join("('{}', '{}', '{}', '{}')".format(r, r.partition("/")[0], "/" + r.partition("/")[2], v) for r, v in RULES)
    return f"""
    WITH p AS (
      SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    r(rule, rule_host, rule_path, verdict) AS (VALUES {rules}),
    f AS (
      SELECT p.page_id, any_value(p.host) AS host, any_value(p.path) AS path, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS told
      FROM p LEFT JOIN r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path) GROUP BY p.page_id),
    hosts AS (
      SELECT host, CASE WHEN len(string_split(host, '.')) <= 2 THEN host ELSE array_to_string(string_split(host, '.')[-2:], '.') END AS domain,
        string_split(host, '.')[-1] AS suffix, CAST(count(told) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE told = 'block') AS DOUBLE) AS bad FROM f GROUP BY host),
    domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
    suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
    root AS (SELECT (sum(bad) + 1) / (sum(n) + 2) AS mean, (sum(bad) + 1) / (sum(n) + 2) * (1 - (sum(bad) + 1) / (sum(n) + 2)) / (sum(n) + 3) AS now_doubt FROM suffixes),
    {level("at_suffix", "suffixes", "(SELECT mean FROM root)", "(SELECT now_doubt FROM root)", "suffix")},
    d AS (SELECT domains.*, at_suffix.mean AS m, at_suffix.now_doubt AS v FROM domains JOIN at_suffix USING (suffix)),
    {level("at_domain", "d", "m", "v", "domain")},
    h AS (SELECT hosts.*, at_domain.mean AS m, at_domain.now_doubt AS v FROM hosts JOIN at_domain USING (domain)),
    {level("at_host", "h", "m", "v", "host")}
    SELECT page_id, f.host, path, rule, coalesce(told, CASE WHEN round(mean - 1.645 * sqrt(now_doubt), 9) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
    FROM f JOIN at_host ON f.host = at_host.host
    """


@query("op2_host_reputation", _reputation_sql())
def op2_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_reputation.judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def id_class(parts: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % parts


@query("op3_language")
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = id_class(3) == 1
    model = language.learn(docs.where(~held_out), F.col("lang"))
    return language.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op4_repeats")
def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.remove(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return cut.select(
        "doc_id", (F.octet_length("rest") + removed).cast("long").alias("n_bytes"), removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("rest", 256).alias("kept_sha256"),
    )


@query("op5_main_text")
def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query("op6_byte_bpe")
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    decoded = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, round_trip=True)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op7_minhash_prints")
def op7_minhash_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fingerprints.edited(table(spark, sf_dir, "documents")).withColumn("edited_print", fingerprints.fingerprint(F.col("edited_text")))
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("print")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_print")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        fingerprints.likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )


@query(
    "op8_ngram_join",
    """
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (
      SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
    g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
    links AS (
      SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
    reach AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
    SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.y) AS component_id FROM s JOIN reach r ON s.doc_id = r.x GROUP BY s.doc_id, len(s.s)
    """,
)
def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents"))


TOXIC_FROM = 0.3


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = id_class(4) == 2
    scored = toxicity.score(docs, toxicity.learn_from(docs, labels.where(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


@query("op10_island_packing")
def op10_island_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable = table(spark, sf_dir, "embeddings").where(whitening.usable(F.col("embedding")))
    rows = whitening.padded(usable.select("vec_id", whitening.whole_steps(F.col("embedding"), 64, 1_000_000).alias("x")), "x", 1_000_000)
    model = whitening.fit(rows)
    if model is None or not len(model.values):
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    explained = F.lit((model.values / model.trace).tolist())
    each = whitening.whiten(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )


@query("op12_piece_bpe")
def op12_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = piece_bpe.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    coded = piece_bpe.encode(table(spark, sf_dir, "documents"), model, round_trip=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query(
    "op13_hard_negatives",
    """
    WITH v AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_sum(list_transform(list_zip(a.e, v.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 50 = 0),
    p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth FROM s WHERE same),
    n AS (
      SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS nth
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score WHERE p.nth <= 5)
    SELECT anchor_id, positive_id, CAST(nth AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE nth <= 3
    """,
)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(inner_topk.usable(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = rows.select("vec_id", label.alias("label"), inner_topk.whole_steps(F.col("embedding"), 256).alias("v"))
    return hard_negatives.hard_negatives(vectors, vectors.where("vec_id % 50 = 0"))
