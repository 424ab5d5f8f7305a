"""Page-level jobs: admission, features, sections, units, structured data, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fairlead import vocab
from fairlead.functions import text as tx, urls
from fairlead.functions.outline import outline, outline_nodes, outline_text

HEADING_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_JSONLD_SCRIPT = r"""(?is)<script\b[^>]*\btype\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script"""
_UNREAD_BODIES = r"(?is)<!--.*?-->|<(script|style|template)\b[^>]*>.*?</\1\s*>"


def with_page_defaults(pages: DataFrame) -> DataFrame:
    """Fill the snapshot columns a plain (url, html) table does not have."""
    defaults = {
        "requested_url": F.col("url") if "url" in pages.columns else F.lit(None).cast("string"),
        "final_url": F.col("url") if "url" in pages.columns else F.col("requested_url"),
        "raw_html": F.col("html") if "html" in pages.columns else F.lit(None).cast("string"),
        "status_code": F.lit(200),
        "content_type": F.lit("text/html"),
        "fetched_at": F.lit(None).cast("timestamp"),
    }
    for name, value in defaults.items():
        if name not in pages.columns:
            pages = pages.withColumn(name, value)
    return pages


def reject_kind(max_bytes: int = vocab.MAX_PAGE_BYTES) -> Column:
    """First failed admission check in order: URL, status, media type, size, body; NULL when admitted."""
    media = F.lower(F.trim(F.substring_index(F.coalesce("content_type", F.lit("")), ";", 1)))
    body = F.coalesce(F.col("raw_html"), F.lit(""))
    good_url = urls.is_web(F.col("requested_url")) & (urls.host_of(F.col("requested_url")) != "")
    return (
        F.when(~F.coalesce(good_url, F.lit(False)), "invalid_url")
        .when(~F.coalesce(F.col("status_code").between(200, 299), F.lit(False)), "http_status")
        .when(~media.isin(*vocab.HTML_MEDIA_TYPES), "unsupported_content_type")
        .when(F.octet_length(body) > max_bytes, "response_too_large")
        .when(body == "", "invalid_response_body")
    )


def admit_pages(pages: DataFrame, max_bytes: int = vocab.MAX_PAGE_BYTES) -> tuple[DataFrame, DataFrame]:
    tagged = with_page_defaults(pages).withColumn("reject_kind", reject_kind(max_bytes))
    return (
        tagged.where(F.col("reject_kind").isNull()).drop("reject_kind"),
        tagged.where(F.col("reject_kind").isNotNull()),
    )


def _unread_removed(html: Column) -> Column:
    return F.regexp_replace(html, _UNREAD_BODIES, "")


def _unescape(text: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def flat_text(fragment: Column) -> Column:
    """Tag-free, unescaped, whitespace-collapsed text of a fragment without nested layout."""
    return tx.collapse(_unescape(F.regexp_replace(fragment, r"(?s)<[^>]*>", " ")))


def fragment_lines(html: Column) -> Column:
    """Text of an HTML fragment with one line per text piece."""
    pieces = F.transform(F.split(_unread_removed(html), r"<[^>]*>"), lambda p: _unescape(F.trim(p)))
    return F.array_join(F.filter(pieces, lambda p: p.rlike(r"\S")), "\n")


def title_tag(html: Column) -> Column:
    return tx.blank_to_null(flat_text(F.regexp_extract(_unread_removed(html), r"(?is)<title\b[^>]*>(.*?)</title", 1)))


def first_h1(html: Column) -> Column:
    return tx.blank_to_null(flat_text(F.regexp_extract(_unread_removed(html), r"(?is)<h1\b[^>]*>(.*?)</h1", 1)))


def page_title(html: Column) -> Column:
    """First H1, else the title tag."""
    return F.coalesce(first_h1(html), title_tag(html))


def meta_property(html: Column, name: str) -> Column:
    tag = F.regexp_extract(html, rf"""(?is)<meta\b[^>]*\bproperty\s*=\s*["']{name}["'][^>]*>""", 0)
    quoted = F.regexp_extract(tag, r"""(?is)\bcontent\s*=\s*(?:"([^"]*)"|'[^']*')""", 1)
    single = F.regexp_extract(tag, r"""(?is)\bcontent\s*=\s*'([^']*)'""", 1)
    return tx.blank_to_null(tx.collapse(_unescape(F.coalesce(tx.blank_to_null(quoted), single))))


def canonical_href(html: Column) -> Column:
    """Target of ``<link rel=canonical>`` as written, else NULL."""
    tag = F.regexp_extract(html, r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?[^"'>]*\bcanonical\b)[^>]*>""", 0)
    return _unescape(tx.blank_to_null(F.regexp_extract(tag, r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""", 1)))


def with_canonical(pages: DataFrame, html: str = "raw_html", final_url: str = "final_url") -> DataFrame:
    """Adds ``canonical``: the page's own canonical link when it is a web URL, else the final URL, canonicalised."""
    step = pages.withColumn("_href", canonical_href(F.col(html)))
    step = step.withColumn("_target", F.when(F.col("_href").isNotNull(), urls.resolve_url(F.col(final_url), F.col("_href"))))
    step = step.withColumn("_self", F.when(urls.is_web(F.col("_target")), F.col("_target")).otherwise(F.col(final_url)))
    return step.withColumn("canonical", urls.canonical_url(F.col("_self"))).drop("_href", "_target", "_self")


def tidy_lines(text: Column) -> Column:
    """Lines without surrounding or repeated blanks, at most one empty line between two, none at the ends."""
    lines = F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
    clean = F.transform(lines, lambda l: F.regexp_replace(F.regexp_replace(l, r"[\t ]+", " "), r"(?U)^\s+|\s+$", ""))
    return F.regexp_replace(F.regexp_replace(F.array_join(clean, "\n"), r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def page_features(pages: DataFrame, outlined: tuple[str, ...] = ("text", "nodes")) -> DataFrame:
    """Parse every page once: text, elements, structured data, titles. Cache this, not the HTML.

    ``outlined``: which of ``text`` and ``nodes`` the job reads; the outline is one column to the planner, which cannot drop half of it.
    """
    pages = with_page_defaults(pages)
    make = {("text",): outline_text, ("nodes",): outline_nodes, ("text", "nodes"): outline}[outlined]
    parsed = with_canonical(pages).withColumn("_outline", make("raw_html", "final_url"))
    one = F.col("_outline") if len(outlined) == 1 else F.col(f"_outline.{outlined[0]}")
    many = one if len(outlined) == 1 else F.col("_outline.nodes")
    return parsed.select(
        *[c for c in pages.columns if c not in ("raw_html", "html", "canonical")],
        *([F.coalesce(tidy_lines(one), F.lit("")).alias("text")] if "text" in outlined else []),
        one.isNull().alias("unread"),
        *([F.coalesce(many, F.array()).alias("nodes")] if "nodes" in outlined else []),
        jsonld_scripts(F.col("raw_html")).alias("jsonld"),
        title_tag(F.col("raw_html")).alias("page_title"),
        meta_property(F.col("raw_html"), "og:title").alias("og_title"),
        meta_property(F.col("raw_html"), "og:site_name").alias("og_site"),
        "canonical",
        F.regexp_replace(_unread_removed(F.col("raw_html")), r"<[^>]*>", " ")
        .rlike(tx.rx(r"\bstartup\b|\bentrepreneur")).alias("mentions_startup"),
    )


def page_texts(pages: DataFrame, key: str) -> DataFrame:
    """``key`` and ``text`` of ``page_features``, for jobs that read nothing else of a page."""
    pages = with_page_defaults(pages)
    return pages.select(key, F.coalesce(tidy_lines(outline_text("raw_html", "final_url")), F.lit("")).alias("text"))


def page_elements(pages: DataFrame, key: str) -> DataFrame:
    """``key``, ``nodes`` and ``page_title`` of ``page_features``, for jobs that read nothing else of a page."""
    pages = with_page_defaults(pages)
    nodes = F.coalesce(outline_nodes("raw_html", "final_url"), F.array())
    return pages.select(key, nodes.alias("nodes"), title_tag(F.col("raw_html")).alias("page_title"))


def latest_snapshot(features: DataFrame) -> DataFrame:
    """One row per final URL: the newest snapshot, equal times settled by content."""
    newest = Window.partitionBy("final_url").orderBy(F.desc_nulls_last("fetched_at"), F.xxhash64("text", "page_title", "canonical"), "requested_url")
    return features.withColumn("_nth", F.row_number().over(newest)).where("_nth = 1").drop("_nth")


def aliases(features: DataFrame) -> DataFrame:
    """``alias, final_url``: every canonical URL that names a page; of several pages the one whose final URL it is, then the requested one's."""
    names = F.array(*[
        F.struct(F.lit(rank).alias("rank"), name.alias("alias")) for rank, name in enumerate(
            (urls.canonical_url(F.col("final_url")), urls.canonical_url(F.col("requested_url")), F.col("canonical"))
        )
    ])
    named = features.select("final_url", F.explode(names).alias("n")).where(F.col("n.alias").isNotNull())
    best = named.groupBy(F.col("n.alias").alias("alias")).agg(F.min(F.struct("n.rank", "final_url")).alias("_b"))
    return best.select("alias", "_b.final_url")


def by_alias(features: DataFrame) -> DataFrame:
    """The newest snapshot of each page under every URL that names it (``alias``)."""
    return aliases(features).join(latest_snapshot(features), "final_url")


def tagged(nodes: Column, *tags: str) -> Column:
    return F.filter(nodes, lambda n: n["tag"].isin(*tags))


def texts(nodes: Column) -> Column:
    return F.transform(nodes, lambda n: n["text"])


# --- text units and sections --------------------------------------------------

def units(nodes: Column, text: Column) -> Column:
    """Block texts then sentences, order-preserving distinct, blanks dropped."""
    blocks = texts(tagged(nodes, "tr", "dt", "li", "p"))
    return F.array_distinct(F.filter(F.concat(blocks, tx.sentences(text)), lambda u: u != ""))


def _section_name(text: Column) -> Column:
    return F.btrim(tx.norm_label(text), F.lit("?:"))


def section_list(nodes: Column) -> Column:
    """``array<struct<name, items>>``: each heading with the block texts up to the next heading that closes it."""
    levelled = F.transform(
        F.filter(
            nodes,
            lambda n: n["tag"].isin(*HEADING_TAGS, "p", "li", "tr", "dt")
            | _section_name(n["text"]).isin(*vocab.SECTION_LABELS),
        ),
        lambda n: F.struct(
            n["pos"].alias("pos"), n["tag"].alias("tag"), n["text"].alias("text"),
            F.when(n["tag"].isin(*HEADING_TAGS), F.substring(n["tag"], 2, 1).cast("int"))
            .when(
                n["tag"].isin("strong", "b", "p", "div") & (F.length(n["text"]) <= 60)
                & _section_name(n["text"]).isin(*vocab.SECTION_LABELS),
                F.lit(0),
            ).alias("level"),
        ),
    )
    # level 0 marks a text that only acts as a heading: it closes every section and is closed by any heading
    return tx.bound(levelled, lambda rows: tx.bound(
        F.filter(rows, lambda n: n["level"].isNotNull()), lambda heads: tx.bound(_bodies(rows, heads), _last_of_each)
    ))


def _bodies(levelled: Column, heads: Column) -> Column:
    def body(head: Column) -> Column:
        closers = F.filter(
            heads,
            lambda n: (n["pos"] > head["pos"])
            & ((head["level"] == 0) | (n["level"] == 0) | (n["level"] <= head["level"])),
        )
        stop = F.coalesce(F.get(closers, 0)["pos"], F.lit(2_147_483_647))
        inside = F.filter(
            levelled,
            lambda n: (n["pos"] > head["pos"]) & (n["pos"] < stop) & (n["text"] != "")
            & n["tag"].isin(*HEADING_TAGS, "p", "li", "tr", "dt"),
        )
        return F.struct(_section_name(head["text"]).alias("name"), F.array_distinct(texts(inside)).alias("items"))

    return F.filter(F.transform(heads, body), lambda s: F.size(s["items"]) > 0)


def _last_of_each(found: Column) -> Column:
    names = F.array_distinct(F.transform(found, lambda s: s["name"]))
    # a repeated heading keeps its first place and its last content
    return F.transform(names, lambda name: F.element_at(F.filter(found, lambda s: s["name"] == name), -1))


def is_kind(name: Column, kind: str) -> Column:
    return tx.holds_any(name, vocab.SECTION_ALIASES[kind])


def section_text(sections: Column, kind: str) -> Column:
    """Distinct lines of all sections of a kind, NULL when there are none."""
    lines = F.array_distinct(
        F.flatten(F.transform(F.filter(sections, lambda s: is_kind(s["name"], kind)), lambda s: s["items"]))
    )
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n"))


def sections_table(features: DataFrame, key: str = "final_url") -> DataFrame:
    """One row per section line."""
    rows = features.select(key, F.posexplode(section_list(F.col("nodes"))).alias("section_no", "s"))
    return rows.select(
        key, "section_no", F.col("s.name").alias("name"), F.posexplode("s.items").alias("line_no", "line")
    )


# --- structured data ------------------------------------------------------------

def jsonld_scripts(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(_JSONLD_SCRIPT), F.lit(1))


_STRINGS = "array<string>"


def _none() -> Column:
    return F.array().cast(_STRINGS)


def _objects(items: Column) -> Column:
    return F.filter(F.coalesce(items, _none()), lambda r: r.startswith("{"))


def json_list(body: Column) -> Column:
    """A JSON list's members as JSON texts, any other JSON value as the only member."""
    return F.when(body.startswith("["), F.from_json(body, _STRINGS)).when(body.isNotNull(), F.array(body))


def jsonld_column(scripts: Column) -> Column:
    """All JSON-LD records of a page as JSON texts in reading order; ``@graph`` members come before their holder.

    Malformed scripts are dropped. Pages without scripts never reach the parser.
    """
    top = _objects(F.flatten(F.transform(scripts, lambda s: F.coalesce(json_list(F.get_json_object(s, "$")), _none()))))
    members = F.flatten(F.transform(top, lambda r: F.concat(_graph(r), F.array(r))))
    return F.when(F.size(scripts) > 0, members).otherwise(_none())


def _graph(record: Column) -> Column:
    body = F.get_json_object(record, "$['@graph']")
    return F.when(body.startswith("["), _objects(F.from_json(body, _STRINGS))).otherwise(_none())


def record_types(record: Column) -> Column:
    return F.coalesce(json_list(F.get_json_object(record, "$['@type']")), _none())


def jsonld_records(features: DataFrame, key: str = "final_url") -> DataFrame:
    """One row per JSON-LD record, in reading order."""
    rows = features.select(key, F.posexplode(jsonld_column(F.col("jsonld"))).alias("record_no", "record"))
    return rows.withColumn("types", F.transform(record_types(F.col("record")), F.lower))


# --- links ------------------------------------------------------------------------

def links(features: DataFrame, *keep: str) -> DataFrame:
    """One row per anchor with a web target: position, label, absolute and canonical URL, context."""
    anchors = F.filter("nodes", lambda n: (n["tag"] == "a") & n["href"].isNotNull())
    rows = features.select(*keep, "final_url", F.explode(anchors).alias("a"))
    return rows.select(
        *keep, "final_url", F.col("a.pos").alias("pos"), F.col("a.text").alias("label"),
        urls.resolve_url(F.col("final_url"), F.col("a.href")).alias("url"),
        F.coalesce("a.context", F.lit("")).alias("context"), F.coalesce("a.card", F.lit("")).alias("card"),
    ).where(urls.is_web(F.col("url"))).withColumn("canonical", urls.canonical_url(F.col("url")))


def flat_links(pages: DataFrame, key: str, url: str = "url", html: str = "html") -> DataFrame:
    """Link table straight from HTML with regular expressions: no context, no Python."""
    pattern = r"""(?is)<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)')[^>]*>(.*?)</a\s*>"""
    cleaned = pages.select(key, F.col(url).alias("page_url"), _unread_removed(F.col(html)).alias("body"))
    matched = cleaned.select(
        key, "page_url",
        F.posexplode(F.arrays_zip(
            F.regexp_extract_all("body", F.lit(pattern), F.lit(1)).alias("double"),
            F.regexp_extract_all("body", F.lit(pattern), F.lit(2)).alias("single"),
            F.regexp_extract_all("body", F.lit(pattern), F.lit(3)).alias("inner"),
        )).alias("pos", "m"),
    )
    href = _unescape(F.when(F.col("m.double") == "", F.col("m.single")).otherwise(F.col("m.double")))
    rows = matched.select(
        key, "page_url", "pos", flat_text(F.col("m.inner")).alias("label"),
        urls.resolve_url(F.col("page_url"), href).alias("url"),
    )
    return rows.where(urls.is_web(F.col("url")))


def child_link_column(nodes: Column, base: Column) -> Column:
    """Distinct canonical URLs of anchors that read like links to single opportunities."""
    anchors = F.filter(
        nodes,
        lambda n: (n["tag"] == "a") & n["href"].isNotNull()
        & F.concat_ws(" ", n["text"], n["card"]).rlike(tx.rx(vocab.SHAPE_OPPORTUNITY_RE))
        & n["text"].rlike(tx.rx(vocab.SHAPE_CHILD_LINK_RE)),
    )
    targets = F.filter(F.transform(anchors, lambda n: urls.resolve_url(base, n["href"])), urls.is_web)
    return F.array_distinct(F.transform(targets, urls.canonical_url))


# --- analysis bound -----------------------------------------------------------------

def bound_text(df: DataFrame, column: str, low: int = vocab.MIN_ANALYSIS_CHARS,
               high: int = vocab.MAX_ANALYSIS_CHARS) -> DataFrame:
    """Texts under ``low`` characters are flagged insufficient; the analysed text ends at ``high``."""
    stripped = F.regexp_replace(column, r"(?U)^\s+|\s+$", "")
    return (
        df.withColumn("_bounded", stripped)
        .withColumn("character_count", F.length("_bounded"))
        .withColumn("truncated", F.col("character_count") > high)
        .withColumn("reject_kind", F.when(F.col("character_count") < low, "insufficient_cleaned_content"))
        .withColumn("analysis_text", F.substring("_bounded", 1, high))
        .drop("_bounded")
    )

