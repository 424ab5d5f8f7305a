"""URL, page and text queries over ``pages`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairlead.catalog.base import query
from fairlead.functions import text as tx, urls
from fairlead.operators import classify as cl, notify as nt, pages as pg
from fairlead.sources import bindings as b

CANONICAL = """
    SELECT page_id, base || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canonical FROM (
      SELECT page_id,
             lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1))
               || rtrim(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/') AS base,
             array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'),
               lambda x: regexp_matches(x, '=.') AND NOT starts_with(lower(x), 'utm_'))), '&') AS q
      FROM pages)"""


@query("canonical_url", CANONICAL)
def canonical_url(spark, sf):
    return b.table(spark, sf, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))


@query("page_admission", """
    SELECT CASE WHEN NOT regexp_matches(url, '^https?://[^/]') THEN 'invalid_url' WHEN page_id % 10 = 3 THEN 'http_status'
                WHEN page_id % 10 = 5 THEN 'unsupported_content_type' WHEN octet_length(encode(html)) > 5000 THEN 'response_too_large'
                ELSE 'admitted' END AS outcome, count(*) AS n, cast(sum(page_id) as bigint) AS ids
    FROM pages GROUP BY 1""")
def page_admission(spark, sf):
    pages = b.table(spark, sf, "pages").withColumn(
        "status_code", F.when(F.col("page_id") % 10 == 3, 404).otherwise(200)
    ).withColumn(
        "content_type", F.when(F.col("page_id") % 10 == 5, "application/pdf").otherwise("Text/HTML; charset=utf-8")
    )
    accepted, refused = pg.admit_pages(pages, max_bytes=5000)
    both = accepted.select("page_id", F.lit("admitted").alias("outcome")).unionByName(
        refused.select("page_id", F.col("reject_kind").alias("outcome"))
    )
    return both.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("page_id").alias("ids"))


_UNESCAPED = "replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
_H1 = _UNESCAPED.format(
    r"trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
)


@query("page_title", f"SELECT page_id, {_H1} AS title FROM pages")
def page_title(spark, sf):
    return b.table(spark, sf, "pages").select("page_id", pg.page_title(F.col("html")).alias("title"))


_LINKS = rf"""
    SELECT page_id, pos - 1 AS pos, {_UNESCAPED.format(r"trim(regexp_replace(labels[pos], '\s+', ' ', 'g'))")} AS label,
           regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || hrefs[pos] AS url
    FROM (SELECT page_id, url, unnest(generate_series(1, len(hrefs))) AS pos, hrefs, labels FROM (
      SELECT page_id, url, regexp_extract_all(body, '<a href="([^"]*)">([^<]*)</a>', 1) AS hrefs,
             regexp_extract_all(body, '<a href="([^"]*)">([^<]*)</a>', 2) AS labels
      FROM (SELECT page_id, url, regexp_replace(regexp_replace(html, '(?s)<script>.*?</script>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS body FROM pages)))"""


@query("links", _LINKS)
def links(spark, sf):
    return pg.flat_links(b.table(spark, sf, "pages"), "page_id").select(
        "page_id", F.col("pos").cast("long").alias("pos"), "label", "url"
    )


@query("resolve_links", rf"""
    WITH l AS ({_LINKS})
    SELECT l.page_id, l.pos, l.url,
           regexp_extract(p.url, '^([a-z]+://[^/?#]*)', 1) || regexp_extract(p.url, '^[a-z]+://[^/?#]*(/.*/)', 1) || 'n' || l.pos AS sibling,
           regexp_replace(p.url, '[?#].*$', '') || '?x=' || l.pos AS asked
    FROM l JOIN pages p USING (page_id)""")
def resolve_links(spark, sf):
    pages = b.table(spark, sf, "pages")
    found = pg.flat_links(pages, "page_id").withColumn("pos", F.col("pos").cast("long"))
    place = F.col("pos").cast("string")
    return found.select(
        "page_id", "pos", "url", urls.resolve_url(F.col("page_url"), F.concat(F.lit("./q/../n"), place)).alias("sibling"),
        urls.resolve_url(F.col("page_url"), F.concat(F.lit("?x="), place)).alias("asked"),
    )


_PAGE_TEXT = rf"""
    SELECT page_id, {_UNESCAPED.format('t')} AS text FROM (
      SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
               regexp_replace(b2, '[ \t]+', ' ', 'g'), '\x02+', chr(10), 'g'), ' ?\n ?', chr(10), 'g'),
               '[\n ]*\x01[\x01\n ]*', chr(10) || chr(10), 'g'), '\n\n\n+', chr(10) || chr(10), 'g'), chr(10) || ' ') AS t
      FROM (SELECT page_id, regexp_replace(regexp_replace(body, '</(p|div|section|article|main|ul|ol|table|tr)>|</?h[1-6]>', chr(1), 'g'),
                   '(<[^>]*>)+', chr(2), 'g') AS b2
            FROM (SELECT page_id, regexp_replace(html,
                  '(?s)<script>.*?</script>|<style>.*?</style>|<nav>.*?</nav>|<footer>.*?</footer>|<!--.*?-->|<!DOCTYPE[^>]*>', '', 'g') AS body
                  FROM pages)))"""


@query("page_text", _PAGE_TEXT)
def page_text(spark, sf):
    return pg.page_features(b.table(spark, sf, "pages")).select("page_id", "text")


_SENTENCES = r"""
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, trim(s, ' -•' || chr(9)) AS sentence FROM (
      SELECT doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS i FROM (
        SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)) AS parts
        FROM documents))
    WHERE regexp_matches(s, '\S')"""


@query("sentences", _SENTENCES)
def sentences(spark, sf):
    docs = b.table(spark, sf, "documents")
    rows = docs.select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


@query("text_bound", r"""
    SELECT doc_id, length(t) AS character_count, length(t) > 50000 AS truncated,
           CASE WHEN length(t) < 50 THEN 'insufficient_cleaned_content' END AS reject_kind, md5(substr(t, 1, 50000)) AS analysed
    FROM (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents)""")
def text_bound(spark, sf):
    bound = pg.bound_text(b.table(spark, sf, "documents"), "text")
    return bound.select(
        "doc_id", F.col("character_count").cast("long").alias("character_count"), "truncated", "reject_kind",
        F.md5("analysis_text").alias("analysed"),
    )


_CHUNKS = r"""
    WITH RECURSIVE doc AS (
      SELECT doc_id, list_filter(flatten(list_transform(string_split(t, chr(10)), lambda l: CASE WHEN length(l) <= 3900 THEN [l]
               ELSE list_transform(range(0, cast(ceil(length(l) / 3900.0) as bigint)), lambda i: substr(l, i * 3900 + 1, 3900)) END)), lambda x: true) AS p
      FROM (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents) WHERE t <> ''),
    walk(doc_id, i, open, done) AS (
      SELECT doc_id, cast(1 as bigint), p[1], cast(NULL as varchar) FROM doc
      UNION ALL
      SELECT w.doc_id, w.i + 1,
             CASE WHEN w.open <> '' AND length(w.open) + 1 + length(d.p[w.i + 1]) <= 3900 THEN w.open || chr(10) || d.p[w.i + 1] ELSE d.p[w.i + 1] END,
             CASE WHEN w.open <> '' AND length(w.open) + 1 + length(d.p[w.i + 1]) > 3900 THEN w.open END
      FROM walk w JOIN doc d USING (doc_id) WHERE w.i < len(d.p)),
    found AS (
      SELECT doc_id, i, done AS c FROM walk WHERE done IS NOT NULL
      UNION ALL
      SELECT w.doc_id, w.i + 1, regexp_replace(w.open, '^\s+|\s+$', '', 'g') FROM walk w JOIN doc d USING (doc_id) WHERE w.i = len(d.p) AND w.open <> '')
    SELECT doc_id, count(*) OVER (PARTITION BY doc_id) AS chunk_count,
           row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, sha256(c) AS chunk_fingerprint, length(c) AS chars
    FROM found"""


@query("chunks", _CHUNKS)
def chunks(spark, sf):
    rows = nt.chunks(b.table(spark, sf, "documents"), "doc_id", "text")
    return rows.select(
        "doc_id", F.col("chunk_count").cast("long").alias("chunk_count"), F.col("chunk_index").cast("long").alias("chunk_index"),
        "chunk_fingerprint", F.length("chunk_text").cast("long").alias("chars"),
    )


@query("page_link_score", rf"""
    WITH l AS ({_LINKS})
    SELECT page_id, pos, 1 + CASE WHEN regexp_matches(lower(label), 'privacy|terms|login|sign in|facebook|linkedin|instagram|about|contact|team|blog|news') THEN -5
           WHEN lower(label) IN ('home', 'more') THEN -2 ELSE 0 END AS link_score FROM l""")
def page_link_score(spark, sf):
    found = pg.flat_links(b.table(spark, sf, "pages"), "page_id").select(
        "page_id", F.col("pos").cast("long").alias("pos"), "label", F.lit("").alias("context"),
        urls.canonical_url(F.col("url")).alias("canonical"), F.col("page_url").alias("source_url"),
        F.array().cast("array<string>").alias("category_focus"),
    )
    return cl.score_links(found).select("page_id", "pos", "link_score")
