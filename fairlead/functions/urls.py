"""URL canonicalisation and resolution as column expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fairlead import vocab

_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_DOT_SEGMENT = r"(?:^|/)\.\.?(?:/|$)"


def _clean(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"[\t\r\n]", ""), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _SPLIT, group)


def scheme_of(url: Column) -> Column:
    return F.lower(_part(url, 1))


def path_of(url: Column) -> Column:
    return _part(url, 3)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def is_web(url: Column) -> Column:
    return scheme_of(url).isin("http", "https")


def _decode(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), F.replace(text, F.lit("+"), F.lit(" ")))


def _encode(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _canonical_query(query: Column) -> Column:
    items = F.filter(F.split(query, "&"), lambda item: item.rlike("=."))
    pairs = F.transform(
        items,
        lambda item: F.struct(
            _decode(F.substring_index(item, "=", 1)).alias("k"),
            _decode(F.regexp_replace(item, "^[^=]*=", "")).alias("v"),
        ),
    )
    kept = F.filter(
        pairs,
        lambda p: ~(F.lower(p["k"]).startswith("utm_") | F.lower(p["k"]).isin(*vocab.TRACKING_PARAMETERS)),
    )
    encoded = F.transform(F.array_sort(kept), lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"])))
    return F.array_join(encoded, "&")


def canonical_url(url: Column) -> Column:
    """Lower-cased scheme and authority, no trailing slash, no fragment, sorted non-tracking parameters."""
    url = _clean(url)
    scheme, authority, query = F.lower(_part(url, 1)), F.lower(_part(url, 2)), _part(url, 4)
    path = F.rtrim(_part(url, 3), F.lit("/"))
    tail = F.when(query == "", F.lit("")).otherwise(_canonical_query(query))
    return F.concat(
        F.when(scheme == "", "").otherwise(F.concat(scheme, F.lit(":"))),
        F.when(authority == "", "").otherwise(F.concat(F.lit("//"), authority)),
        F.when((authority != "") & (path != "") & ~path.startswith("/"), F.lit("/")).otherwise(""),
        path,
        F.when(tail == "", "").otherwise(F.concat(F.lit("?"), tail)),
    )


def _drop_dot_segments(path: Column) -> Column:
    """Resolve ``.`` and ``..``; a trailing one leaves a trailing slash."""
    parts = F.slice(F.split(path, "/"), 2, 2_000_000)
    folded = F.aggregate(
        parts,
        F.expr("cast(array() as array<string>)"),
        lambda seen, part: F.when(part == ".", seen)
        .when(part == "..", F.slice(seen, 1, F.greatest(F.size(seen) - 1, F.lit(0))))
        .otherwise(F.array_append(seen, part)),
    )
    rebuilt = F.concat(F.lit("/"), F.array_join(folded, "/"))
    slash = F.when(path.rlike(r"/\.\.?$") & (rebuilt != "/"), F.lit("/")).otherwise("")
    return F.when(path.rlike(_DOT_SEGMENT), F.concat(rebuilt, slash)).otherwise(path)


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of a link found on a page (RFC 3986 reference resolution)."""
    href = F.trim(href)
    origin = F.concat(_part(base, 1), F.lit("://"), _part(base, 2))
    base_path = F.when(_part(base, 3) == "", F.lit("/")).otherwise(_part(base, 3))
    base_query = F.when(_part(base, 4) == "", "").otherwise(F.concat(F.lit("?"), _part(base, 4)))
    suffix = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    path = F.regexp_extract(href, r"^([^?#]*)", 1)
    folder = F.regexp_extract(base_path, r"^(.*/)", 1)
    return (
        F.when(href.isNull(), None)
        .when(href == "", F.concat(origin, _part(base, 3), base_query))
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(_part(base, 1), F.lit(":"), href))
        .when(href.startswith("?"), F.concat(origin, _part(base, 3), href))
        .when(href.startswith("#"), F.concat(origin, _part(base, 3), base_query, href))
        .when(href.startswith("/"), F.concat(origin, _drop_dot_segments(path), suffix))
        .otherwise(F.concat(origin, _drop_dot_segments(F.concat(folder, path)), suffix))
    )


def same_domain(left: Column, right: Column) -> Column:
    a, b = host_of(left), host_of(right)
    return (a == b) | a.endswith(F.concat(F.lit("."), b)) | b.endswith(F.concat(F.lit("."), a))
