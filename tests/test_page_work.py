"""What a job reads of a page is made once, and nothing else is."""

import datetime

from pyspark.sql import functions as F

from fairlead import vocab
from fairlead.functions import dates as dt, text as tx
from fairlead.operators import facts as fx, pages as pg

HTML = "<h1>Harbour Grant</h1><h2>Funding</h2><p>Flights are covered. A certificate is included.</p>"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_benefits_share_their_sentences(spark):
    df = spark.createDataFrame([("Mentorship by staff. It is fully funded. A certificate is included. Mentorship again.",)], "text string")
    found = df.select(fx.benefits(tx.sentences(F.col("text"))).alias("b"))
    assert _plan(found).count("split(") == 1
    assert {(b.label, b.snippet) for b in found.first().b} >= {("Mentorship", "Mentorship by staff."), ("Certification included", "A certificate is included.")}


def test_half_an_outline_is_that_half_of_the_whole(spark):
    pages = spark.createDataFrame([("https://h.example/p", HTML), ("https://h.example/q", None)], "url string, html string")
    whole = pg.page_features(pages)
    for half in ("text", "nodes"):
        one = pg.page_features(pages, (half,))
        assert set(whole.columns) - set(one.columns) == {"text", "nodes"} - {half}
        assert one.orderBy("url").collect() == whole.select(one.columns).orderBy("url").collect()
        assert f"outline_{half}" in _plan(one) and "outline(" not in _plan(one)


def test_cheaper_patterns_find_the_same(spark):
    texts = ["a b", "a  b", " a\tb c ", "a \t b", "\n\n", "x  y z", "", "  ", "\ta", "b\n", "until May 4th, 2026", "2026-05-04", "May 4, 1999", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    t = F.col("t")
    rows = df.select(
        tx.collapse(t).alias("x"), F.trim(F.regexp_replace(t, r"(?U)\s+", " ")).alias("y"), tx.holds_any(t, ("b", "y z")).alias("p"), tx.has_any(t, ("b", "y z")).alias("q"),
        F.size(tx.sentences(t)).alias("n"), dt.parse_date(t).alias("d"),
    ).collect()
    assert all((r.x, r.p) == (r.y, r.q) for r in rows) and [r.n for r in rows[4:9]] == [0, 1, 0, 0, 1]
    assert [str(r.d) for r in rows[-4:]] == ["2026-05-04", "2026-05-04", "None", "None"]


def test_windows_read_spans_and_pairs_of_dates(spark):
    said = [
        ("Applications: May 1st - June 2, 2026", (5, 1), (6, 2)), ("Applications: May 1 to 20, 2026", (5, 1), (5, 20)), ("Application period: 2026-05-01 until June 3, 2026", (5, 1), (6, 3)),
        ("Applications: soon", None, None), ("Applications open on May 1, 2026", None, None), ("Application timeline", None, None),
    ]
    df = spark.createDataFrame([(i, x[0]) for i, x in enumerate(said)], "i int, t string")
    got = df.select("i", fx.app_window(fx.dated_units(F.array("t"))).alias("w")).orderBy("i").collect()
    day = lambda md: md and datetime.date(2026, *md)
    assert [(r.w and r.w.opening, r.w and r.w.deadline) for r in got] == [(day(a), day(b)) for _, a, b in said]
    assert _plan(df.select(fx.app_window(fx.dated_units(F.array("t"))).alias("w"))).count("regexp_extract_all") == 1
    assert vocab.WINDOW_WORDS
