import duckdb
from pyspark.sql import functions as F

from fairlead.llm import host_reputation as hr
from fairlead.llm.catalog import RULES
from tests.llm.helpers import SF

CASES = [
    ("http://Example.ORG/en/12?x", "example.org", "/en/12", "example.org/en/1", "block"),
    ("https://a.example.org/es/", "a.example.org", "/es/", "example.org/es/", "block"),
    ("http://other.org", "other.org", "", None, "allow"),  # the path is empty, so no rule with a path fits
    ("http://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
    ("x://a.com/de/1#z", "a.com", "/de/1", "com/de/", "block"),
    ("x://a.com/fr/1", "a.com", "/fr/1", "com/fr/", "allow"),
    ("no scheme", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://h\nost/p\nq", "h\nost", "/p\nq", None, "allow"),
    ("http://ÄB.com:80?de", "Äb.com:80", "", None, "allow"),
]

def test_parts_and_rules(spark):
    df = spark.createDataFrame([(i, c[0], "mine") for i, c in enumerate(CASES)], "page_id long, url string, rule string")
    found = {r["page_id"]: r for r in hr.judge(df, RULES).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(CASES):
        assert (found[i]["host"], found[i]["path"], found[i]["rule"], found[i]["verdict"]) == (host, path, rule, verdict), CASES[i]

def test_reputation_shrinks_towards_domain_and_suffix(spark):
    rows = [(f"http://bad{i}.spam.net/x/{j}", True) for i in range(4) for j in range(30)]
    rows += [(f"http://h{i}.fine.net/{j}", False) for i in range(6) for j in range(30)]
    rows += [("http://new.spam.net/", None), ("http://new.fine.net/", None), ("http://lonely.net/", None), ("http://elsewhere.zz/", None)]
    df = spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(rows)], "page_id long, url string, label boolean")

    judged = hr.judge(df, [], label=F.col("label"))
    bound = {r["host"]: (r["bound"], r["verdict"]) for r in judged.select("host", "bound", "verdict").distinct().collect()}
    assert bound["bad0.spam.net"][1] == "block"
    assert bound["h0.fine.net"][1] == bound["new.fine.net"][1] == bound["elsewhere.zz"][1] == bound["lonely.net"][1] == "allow"
    assert bound["new.fine.net"][0] < bound["new.spam.net"][0] < bound["bad0.spam.net"][0]
    assert hr.judge(df.limit(0), RULES).count() == 0

def test_query_matches_a_plain_computation(spark):
    from fairlead.llm.catalog import QUERIES

    pages = duckdb.sql(f"select page_id, url from '{SF}/pages.parquet'").fetchall()
    found = {r["page_id"]: r for r in QUERIES["op2_host_reputation"](spark, SF).collect()}
    assert len(found) == len(pages)
    for page_id, url in pages:
        host, path = url.partition("://")[2].partition("/")[0::2]
        path = "/" + path.partition("?")[0].partition("#")[0]
        rules = [(len(r), r, v) for r, v in RULES if ("." + host).endswith("." + r.partition("/")[0]) and path.startswith("/" + r.partition("/")[2])]
        if rules:
            assert (found[page_id]["rule"], found[page_id]["verdict"]) == max(rules)[1:]
        else:
            assert found[page_id]["rule"] is None
