"""Search, discovery and experience queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairlead import vocab
from fairlead.catalog.base import query
from fairlead.functions import urls
from fairlead.operators import classify as cl, discover as ds, enrich as en, matching as mt, ordered, pages as pg, reports as rp, search as sr
from fairlead.sources import bindings as b

# --- search hits ---------------------------------------------------------------------

_SCORED = """
  scored AS (
    SELECT *, (CASE WHEN part_no % 4 IN (0, 2) OR path_no = 0 THEN 3 ELSE 0 END) + (CASE WHEN path_no = 0 OR part_no % 3 = 0 THEN 2 ELSE 0 END)
           + (CASE WHEN part_no % 3 = 2 OR path_no = 4 THEN 1 ELSE 0 END) + (CASE WHEN rank <= 3 THEN 1 ELSE 0 END)
           - (CASE WHEN host_no IN (1, 3) THEN 10 ELSE 0 END) - (CASE WHEN path_no IN (2, 3) THEN 6 ELSE 0 END) AS search_score FROM hits)"""


def search_sql(select: str) -> str:
    return b.with_views("", "hits").rstrip() + "," + _SCORED + select


def _scored(spark, sf):
    return sr.score_hits(b.view(spark, sf, "hits"))


@query("search_score", search_sql(" SELECT profile_id, seq, rank, search_score FROM scored"))
def search_score(spark, sf):
    return _scored(spark, sf).select("profile_id", "seq", "rank", "search_score")


_BEST = """ SELECT profile_id, canonical, search_score, rank, seq AS best_seq, first_seq, hits FROM (
    SELECT *, row_number() OVER (PARTITION BY profile_id, canonical ORDER BY search_score DESC, rank, seq) AS n,
           min(seq) OVER (PARTITION BY profile_id, canonical) AS first_seq, count(*) OVER (PARTITION BY profile_id, canonical) AS hits
    FROM scored WHERE search_score >= 0) WHERE n = 1"""


def _merged(spark, sf):
    return sr.merge_hits(_scored(spark, sf), ["profile_id", "canonical"])


@query("search_merge", search_sql(_BEST))
def search_merge(spark, sf):
    return _merged(spark, sf)[0].select("profile_id", "canonical", "search_score", "rank", F.col("seq").alias("best_seq"), "first_seq", "hits")


@query("search_provenance", search_sql(""" SELECT profile_id, canonical, query, query_mode, rank, min(seq) AS first_seq FROM scored
    WHERE search_score >= 0 GROUP BY 1, 2, 3, 4, 5"""))
def search_provenance(spark, sf):
    return _merged(spark, sf)[1].select("profile_id", "canonical", "query", "query_mode", "rank", "first_seq")


@query("arrival_cap", search_sql(""", firsts AS (SELECT profile_id, canonical, min(seq) AS f FROM scored WHERE search_score >= 0 GROUP BY 1, 2),
    cuts AS (SELECT profile_id, f AS cut FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY f) AS n FROM firsts) WHERE n = 80)
    SELECT profile_id, canonical, seq FROM scored LEFT JOIN cuts USING (profile_id) WHERE search_score >= 0 AND (cut IS NULL OR seq <= cut)"""))
def arrival_cap(spark, sf):
    kept = _scored(spark, sf).where(F.col("search_score") >= 0)
    return sr.arrival_cap(kept, "profile_id", "canonical", "seq", sr.CANDIDATE_CAP).select("profile_id", "canonical", "seq")


@query("topk", search_sql(f""", best AS ({_BEST}) SELECT profile_id, canonical, fetch_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY search_score DESC, rank, canonical) AS fetch_rank FROM best) WHERE fetch_rank <= 30"""))
def topk(spark, sf):
    return sr.fetch_list(_merged(spark, sf)[0], "profile_id", sr.FETCH_CAP).select("profile_id", "canonical", "fetch_rank")


@query("virtual_sources", b.with_views("""
    SELECT 'search-recorded' || rank AS id, 'hub' AS kind FROM hits GROUP BY rank""", "hits"))
def virtual_sources(spark, sf):
    named = b.view(spark, sf, "hits").withColumn("provider", F.concat(F.lit(" Recorded"), F.col("rank").cast("string"), F.lit("! ")))
    return sr.virtual_sources(named).select("id", F.lit("hub").alias("kind"))


@query("observe_shapes", search_sql(f""", best AS ({_BEST}) SELECT profile_id, canonical, CASE WHEN best_seq % 3 = 0 THEN 'uncertain' WHEN best_seq % 3 = 1 THEN 'organization_page' END AS page_shape,
    CASE WHEN best_seq % 3 = 0 THEN true WHEN best_seq % 3 = 1 THEN false END AS proceeded FROM best"""))
def observe_shapes(spark, sf):
    candidates = _merged(spark, sf)[0].withColumn("page_no", F.col("seq"))
    keyed = candidates.withColumn("canonical", F.concat_ws(" ", "canonical", F.col("profile_id").cast("string")))
    shapes = keyed.where(F.col("page_no") % 3 < 2).select(
        "canonical", F.when(F.col("page_no") % 3 == 0, "uncertain").otherwise("organization_page").alias("shape"),
        F.array(F.lit("x")).alias("shape_signals"),
    )
    refused = shapes.where(F.col("shape") != "uncertain").select("canonical", F.lit("page shape").alias("reason"))
    seen = sr.observe_shapes(keyed, shapes, refused)
    return seen.select("profile_id", F.substring_index("canonical", " ", 1).alias("canonical"), "page_shape", F.col("proceeded_to_extraction").alias("proceeded"))


@query("originating", search_sql(""", k AS (SELECT profile_id, canonical, max(seq) AS s FROM scored GROUP BY 1, 2)
    SELECT profile_id, canonical, arg_max(rank, seq) AS rank FROM scored GROUP BY 1, 2"""))
def originating(spark, sf):
    hits = _scored(spark, sf)
    records = hits.select("profile_id", "canonical", F.concat("canonical", F.lit("?utm_source=z")).alias("source_url"), F.lit(None).cast("string").alias("official_url")).distinct()
    found = sr.originating(records.withColumnRenamed("canonical", "own"), hits, ["profile_id"], "rank", "seq", last=True)
    return found.select("profile_id", F.col("own").alias("canonical"), "rank")


def _rotation(day: str) -> str:
    return f"(date '{day}' - date '0001-01-01' + 1)"


def _plan_sql() -> str:
    rows = []
    core, rest = vocab.MATCH_FAMILIES[:2], vocab.MATCH_FAMILIES[2:]
    listed = lambda items: "[" + ", ".join("{'f': '" + n + "', 't': '" + t + "'}" for n, t in items) + "]"
    for i in range(12):
        if i < 2:
            pick = f"({listed(core)})[{i} + 1]"
        elif i < 8:
            pick = f"({listed(rest)})[(r + {i - 2}) % 10 + 1]"
        else:
            pick = f"({listed(vocab.DISCOVERY_FAMILIES)})[(r + {i - 8}) % 10 + 1]"
        focus = f"CASE WHEN (r + {i}) % 2 = 0 THEN skill ELSE second_skill END" if i < 8 else "''"
        rows.append(f"SELECT profile_id, {i} AS query_no, '{'match' if i < 8 else 'discovery'}' AS mode, {pick} AS c, {focus} AS focus, study_year, nationality, residence FROM base")
    body = " UNION ALL ".join(rows)
    return f""" SELECT profile_id, query_no, mode, c.f AS family, trim(regexp_replace(replace(replace(replace(c.t, '{{focus}}', focus), '{{student}}',
        CASE WHEN study_year <> 0 THEN 'undergraduate student' ELSE 'student' END), '{{international}}',
        CASE WHEN regexp_matches(lower(nationality || ' ' || residence), 'nigeria|mauritius|africa') THEN 'Africa global' ELSE 'international global' END), ' +', ' ', 'g')) AS text
        FROM (WITH base AS (SELECT *, {_rotation(b.AS_OF[:10])} AS r FROM seekers) {body})"""


@query("query_plan", b.with_views(_plan_sql(), "seekers"))
def query_plan(spark, sf):
    plan = sr.query_plan(b.seeker_profiles(spark, sf), F.to_date(F.lit(b.AS_OF[:10])), sr.MAX_QUERIES, focuses=sr.FOCUSES)
    return plan.select(F.col("profile_id").cast("long").alias("profile_id"), "query_no", "mode", "family", "text")


# --- experience ------------------------------------------------------------------------

@query("interval_union", """
    WITH x AS (SELECT l_suppkey AS profile_id, cast(date_trunc('month', l_shipdate) as date) AS s,
                      least(date '2000-06-30', coalesce(CASE WHEN l_linenumber < 7 THEN last_day(cast(date_trunc('month', l_shipdate) as date) + to_months(cast(l_quantity as integer) % 12)) END, date '2000-06-30')) AS e
               FROM lineitem),
    y AS (SELECT *, max(e) OVER (PARTITION BY profile_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x WHERE s <= date '2000-06-30'),
    z AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY profile_id ORDER BY s, e) AS island FROM y),
    u AS (SELECT profile_id, island, min(s) AS a, max(e) AS z FROM z GROUP BY 1, 2)
    SELECT profile_id, cast(sum(z - a + 1) as bigint) AS days, count(*) AS stretches, min(a) AS first_day, max(z) AS last_day FROM u GROUP BY 1""")
def interval_union(spark, sf):
    start = F.to_date(F.date_trunc("month", "l_shipdate"))
    months = F.col("l_quantity").cast("int") % 12
    rows = b.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("profile_id"), start.alias("s"), F.when(F.col("l_linenumber") < 7, F.last_day(F.add_months(start, months))).alias("e")
    )
    return mt.interval_union(rows, "profile_id", "s", "e", F.to_date(F.lit("2000-06-30")))


# --- discovery ---------------------------------------------------------------------------

def _graph_candidates(spark, sf):
    """Nations as sources, their customers as links, the customers' orders as the links of hub pages."""
    nation, customer, orders = (b.table(spark, sf, t) for t in ("nation", "customer", "orders"))
    walk = lambda x, y, z: F.struct(x.cast("long").alias("a"), y.cast("long").alias("b"), z.cast("long").alias("c"))
    people = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    base = (F.col("n_regionkey").alias("run_id"), F.col("n_nationkey").alias("source_no"))
    cap = (3 + F.col("n_nationkey") % 5).alias("max_links")
    start = walk(F.col("n_nationkey"), F.col("c_custkey"), F.lit(-1))
    one = people.select(
        *base, start.alias("seq"), F.lit(1).alias("depth"), walk(F.lit(-1), F.lit(-1), F.lit(-1)).alias("parent_seq"),
        F.concat(F.lit("u"), (F.col("c_custkey") % 400).cast("string")).alias("url"), (F.col("c_custkey") % 3 != 0).alias("eligible"),
        (F.col("c_custkey") % 7 != 0).alias("loadable"), (F.col("c_custkey") % 2 == 0).alias("is_hub"), cap, F.lit(False).alias("pinned"),
    )
    two = people.where(F.col("c_custkey") % 2 == 0).join(orders, F.col("o_custkey") == F.col("c_custkey")).select(
        *base, walk(F.col("n_nationkey"), F.col("c_custkey"), F.col("o_orderkey")).alias("seq"), F.lit(2).alias("depth"), start.alias("parent_seq"),
        F.concat(F.lit("u"), (F.col("o_orderkey") % 700).cast("string")).alias("url"), (F.col("o_orderkey") % 2 == 0).alias("eligible"),
        F.lit(True).alias("loadable"), F.lit(False).alias("is_hub"), cap, F.lit(False).alias("pinned"),
    )
    return one.unionByName(two)


def _two_hop_sql(rounds: int = 12) -> str:
    parts = ["""c AS MATERIALIZED (
      SELECT n_regionkey AS run_id, n_nationkey AS source_no, [n_nationkey, c_custkey, -1] AS seq, 1 AS depth, [-1, -1, -1] AS parent, 'u' || c_custkey % 400 AS url,
             c_custkey % 3 <> 0 AND c_custkey % 7 <> 0 AS loads, c_custkey % 2 = 0 AS hub, 3 + n_nationkey % 5 AS cap FROM customer JOIN nation ON c_nationkey = n_nationkey
      UNION ALL
      SELECT n_regionkey, n_nationkey, [n_nationkey, c_custkey, o_orderkey], 2, [n_nationkey, c_custkey, -1], 'u' || o_orderkey % 700, o_orderkey % 2 = 0, false, 3 + n_nationkey % 5
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 2 = 0)""",
             "v0 AS (SELECT run_id, seq FROM c WHERE false)"]
    for i in range(1, rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT c.*, min(c.seq) OVER (PARTITION BY c.run_id, c.url) AS owner FROM c LEFT JOIN v{i - 1} h ON h.run_id = c.run_id AND h.seq = c.parent WHERE c.depth = 1 OR h.seq IS NOT NULL)")
        parts.append(f"r{i} AS MATERIALIZED (SELECT * FROM a{i} WHERE seq = owner)")
        parts.append(f"s{i} AS (SELECT *, row_number() OVER (PARTITION BY run_id, source_no ORDER BY seq) AS n FROM r{i} WHERE loads)")
        parts.append(f"g{i} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS m FROM s{i} WHERE n <= cap)")
        parts.append(f"v{i} AS MATERIALIZED (SELECT run_id, seq FROM g{i} WHERE m <= 20 AND depth = 1 AND hub)")
    return "WITH " + ", ".join(parts) + f""" SELECT r.run_id, cast(r.seq[1] as bigint) AS source, cast(r.seq[2] as bigint) AS link, cast(r.seq[3] as bigint) AS child, r.url, g.seq IS NOT NULL AS visited
        FROM r{rounds} r LEFT JOIN (SELECT * FROM g{rounds} WHERE m <= 20) g ON g.run_id = r.run_id AND g.seq = r.seq"""


@query("two_hop", _two_hop_sql())
def two_hop(spark, sf):
    decided = ds.settle_visits(_graph_candidates(spark, sf), max_pages=20)
    return decided.select("run_id", F.col("seq.a").alias("source"), F.col("seq.b").alias("link"), F.col("seq.c").alias("child"), "url", "visited")


@query("capped_frontier", """
    SELECT run_id, source_no, link FROM (
      SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY source_no, link) AS m FROM (
        SELECT n_regionkey AS run_id, n_nationkey AS source_no, c_custkey AS link, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) AS n
        FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE n <= 3 + source_no % 5) WHERE m <= 20""")
def capped_frontier(spark, sf):
    links = b.table(spark, sf, "customer").join(b.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_regionkey").alias("run_id"), F.col("n_nationkey").alias("source_no"), F.struct("n_nationkey", "c_custkey").alias("seq"),
        F.col("c_custkey").alias("link"), (3 + F.col("n_nationkey") % 5).alias("max_links"),
    )
    return ds.capped_frontier(links, "run_id", "source_no", "seq", "max_links", 20).select("run_id", "source_no", "link")


@query("host_top_links")
def host_top_links(spark, sf):
    """Page links scored against their own site, best five per host."""
    pages = b.table(spark, sf, "pages")
    found = pg.flat_links(pages, "page_id").select(
        "page_id", "pos", "label", F.lit("").alias("context"), urls.canonical_url(F.col("url")).alias("canonical"),
        F.col("page_url").alias("source_url"), F.array().cast("array<string>").alias("category_focus"),
    )
    scored = cl.classify_links(cl.score_links(found)).withColumn("host", urls.host_of(F.col("canonical")))
    order = [F.desc("link_score"), F.asc("page_id"), F.asc("pos")]
    return ordered.top_k(scored, ["host"], order, 5).select("host", "rank", "page_id", "label", "canonical", "link_score", "link_class")


@query("failures_union", search_sql(""" SELECT stage, count(*) AS n FROM (
    SELECT 'search' AS stage FROM scored WHERE search_score < 0 UNION ALL SELECT 'fetch' FROM pages WHERE page_id % 10 = 3) GROUP BY 1"""))
def failures_union(spark, sf):
    _, refused = pg.admit_pages(b.table(spark, sf, "pages").withColumn("status_code", F.when(F.col("page_id") % 10 == 3, 500).otherwise(200)))
    noise = _scored(spark, sf).where(F.col("search_score") < 0)
    union = rp.failures_union(
        noise.select(F.lit("search").alias("stage"), "url", "query", "provider", F.lit("noise").alias("reason")),
        refused.select(F.lit("fetch").alias("stage"), F.col("requested_url").alias("url"), F.col("reject_kind").alias("reason")),
    )
    return union.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


# --- overrides and page names ------------------------------------------------------

@query("override_rejects", b.with_views("""
    SELECT notice_id, path, CASE WHEN path = 'nowhere' THEN 'unsupported override field' ELSE 'override value does not fit the field' END AS reason
    FROM (SELECT notice_id, ['deadline', 'title', 'nowhere', 'eligibility.minimum_age'][1 + notice_id % 4] AS path, (notice_id // 4) % 4 AS v FROM notices)
    WHERE path = 'nowhere' OR path = 'deadline' AND v IN (1, 2) OR path = 'eligibility.minimum_age' AND v IN (0, 1)""", "notices"))
def override_rejects(spark, sf):
    """Dates, words, numbers and nulls given to a date, a text, an unknown field and a number."""
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), n.cast("int"))
    leaves = b.view(spark, sf, "notices").select(
        "notice_id", "url", pick(("deadline", "title", "nowhere", "eligibility.minimum_age"), F.col("notice_id") % 4).alias("path"),
        pick(('"2027-05-01"', '"some words"', "12", "null"), F.floor(F.col("notice_id") / 4) % 4).alias("value"),
    )
    return en.override_rejects(leaves).select("notice_id", "path", "reason")


@query("page_alias", """
    WITH n AS (SELECT page_id AS a, 'https://final.example/' || (page_id // 2) AS f, unnest([
                 {'rank': 0, 'alias': 'https://final.example/' || (page_id // 2)}, {'rank': 1, 'alias': 'https://asked.example/' || (page_id % 50)},
                 {'rank': 2, 'alias': 'https://own.example/' || (page_id // 3)}]) AS n FROM pages)
    SELECT n.alias AS alias, arg_min(f, (n.rank, f)) AS final_url FROM n GROUP BY n.alias""")
def page_alias(spark, sf):
    """Requested, final and own canonical URL of every page; several pages may claim a name."""
    at = lambda host, number: F.concat(F.lit(f"https://{host}.example/"), number.cast("long").cast("string"))
    p = F.col("page_id")
    rows = b.table(spark, sf, "pages").select(
        at("asked", p % 50).alias("requested_url"), at("final", F.floor(p / 2)).alias("final_url"), at("own", F.floor(p / 3)).alias("canonical")
    )
    return pg.aliases(rows)
