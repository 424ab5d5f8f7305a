"""Single rules on literal rows."""

from datetime import datetime
from urllib.parse import urljoin

from pyspark.sql import functions as F

from fairlead.functions import urls
from fairlead.operators import assess as av, classify as cl, geo, notify as nt


def test_canonical_url(spark):
    rows = [
        ("HTTPS://Example.ORG/a/?utm_source=x&b=2&a=1#top", "https://example.org/a?a=1&b=2"),
        ("https://example.org/a?fbclid=9&q=&z", "https://example.org/a"),
        ("https://example.org/p?q=a+b&r=%7Ex*", "https://example.org/p?q=a+b&r=~x%2A"),
        ("https://example.org/", "https://example.org"),
        ("https://example.org/p?x=%zz", "https://example.org/p?x=%25zz"),
    ]
    df = spark.createDataFrame(rows, "u string, e string")
    for r in df.select("u", "e", urls.canonical_url(F.col("u")).alias("c")).collect():
        assert r.c == r.e, r.u


def test_resolve_url_like_urljoin(spark):
    base = "https://h.example/a/b/c?q=1"
    refs = ["/x", "y", "../z", "./w/../v", "?k=2", "#f", "//o.example/p", "https://q.example/", "mailto:a@b", "../../../up", "s/."]
    df = spark.createDataFrame([(base, r) for r in refs], "b string, r string")
    for row in df.select("b", "r", urls.resolve_url(F.col("b"), F.col("r")).alias("u")).collect():
        assert row.u == urljoin(row.b, row.r), row.r


def test_status_table(spark):
    at = datetime(2026, 8, 1, 12)
    cases = [
        (datetime(2026, 8, 1, 11, 59, 59), None, False, False, "closed"), (datetime(2026, 8, 8, 12), None, False, False, "closing_soon"),
        (datetime(2026, 8, 8, 12, 0, 1), None, False, True, "open"), (datetime(2026, 9, 9), None, False, False, "unknown"),
        (None, datetime(2026, 9, 1), False, False, "opening_soon"), (None, datetime(2027, 1, 1), True, False, "future_cycle"),
        (None, datetime(2026, 1, 1), False, False, "unknown"), (None, None, True, False, "open"),
    ]
    df = spark.createDataFrame([(*c[:2], c[2], c[3], c[4], at) for c in cases], "d timestamp, o timestamp, r boolean, a boolean, e string, t timestamp")
    got = df.select("e", cl.derive_status(F.col("d"), F.to_date("o"), F.col("t"), F.col("r"), F.col("a")).alias("s")).collect()
    assert [g.s for g in got] == [g.e for g in got]


def test_places(spark):
    cases = [
        ("Nigeria", "Africa", True), ("France", "EMEA", True), ("Singapore", "APAC", True), ("Mauritius", "Canada", False), ("Nigerian", "nigeria", True),
        ("Nigeria", "EU", False), ("Japan", "Worldwide", True), ("USA", "North America", True),
    ]
    df = spark.createDataFrame(cases, "p string, r string, e boolean")
    got = df.select("e", geo.admits(geo.admitted_places(F.array("r")), geo.places(F.array("p"))).alias("m")).collect()
    assert all(g.e == g.m for g in got)


def test_bands_and_actions(spark):
    df = spark.createDataFrame([(86,), (76,), (61,), (47,), (32,)], "s int").select(av.priority_for_score(F.col("s")).alias("b"))
    assert [r.b for r in df.collect()] == ["exceptional", "strong_match", "worth_checking", "low_priority", "not_actionable"]
    rows = [("eligible", "exceptional", "open", "apply_now"), ("not_eligible", "exceptional", "open", "ignore"), ("future_eligible", "strong_match", "open", "track"),
            ("eligible", "strong_match", "opening_soon", "prepare"), ("eligible", "discovery", "open", "save"), ("eligible", "low_priority", "future_cycle", "track")]
    df = spark.createDataFrame(rows, "e string, b string, s string, x string")
    assert all(r.a == r.x for r in df.select("x", av.recommended_action(F.col("e"), F.col("b"), F.col("s")).alias("a")).collect())


def _split(text, size):
    text, out, current = text.strip(), [], ""
    for line in text.splitlines() if text else []:
        for piece in [line[i:i + size] for i in range(0, len(line), size)] or [""]:
            joined = f"{current}\n{piece}" if current else piece
            if len(joined) <= size:
                current = joined
            else:
                if current:
                    out.append(current)
                current = piece
    return out + [current.strip()] if current else out


def test_chunks_against_plain_loop(spark):
    texts = ["", "  a\n\n" + "b" * 250 + "\nshort\n" + "c" * 99, "x" * 100, "x" * 101, "\n".join("line %d" % i for i in range(80)), "p\r\nq\n\n\nr"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {}
    for r in nt.chunks(df, "k", "t", 100).orderBy("k", "chunk_index").collect():
        got.setdefault(r.k, []).append(r.chunk_text)
    assert {k: _split(t, 100) for k, t in enumerate(texts) if _split(t, 100)} == got
