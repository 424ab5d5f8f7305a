"""Text normalisation as JVM-side column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

#: A zero-based sentence splitter: after end punctuation, or at line breaks.
SENTENCE_BREAK = r"(?<=[.!?])\s+|\n+"
#: Characters trimmed from both ends of a sentence.
SENTENCE_TRIM = " -•\t"


def rx(pattern: str) -> str:
    """Case-insensitive pattern whose classes and word edges are Unicode-aware."""
    return "(?iU)" + pattern


def any_of(terms) -> str:
    return "(?:" + "|".join(re.escape(term).replace(r"\ ", " ") for term in terms) + ")"


def whole_words(terms) -> str:
    return r"(?U)\b" + any_of(terms) + r"\b"


def has_any(text: Column, terms) -> Column:
    """True where the text contains one of a fixed list of terms as a substring."""
    return text.rlike(any_of(terms))


def holds_any(text: Column, terms) -> Column:
    """``has_any`` without a pattern, for a column or field that costs nothing to read again."""
    return reduce(Column.__or__, [F.contains(text, F.lit(term)) for term in terms])


def casefold(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def collapse(text: Column) -> Column:
    """Single-spaced text; a plain space between two words is no match, as most blanks are one."""
    return F.trim(F.regexp_replace(text, r"(?U)\s(?:(?<=[^ ])\s*|\s+)", " "))


def norm_ws(text: Column) -> Column:
    return collapse(casefold(text))


def norm_label(text: Column) -> Column:
    """Whitespace-normalised, casefolded, with typographic apostrophes made plain."""
    return collapse(F.replace(casefold(text), F.lit("’"), F.lit("'")))


def norm_alnum(text: Column) -> Column:
    """Casefolded words of letters and digits, single-spaced."""
    return F.trim(F.regexp_replace(casefold(text), r"[^\p{L}\p{N}]+", " "))


def norm_identity(text: Column) -> Column:
    return F.trim(F.regexp_replace(casefold(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", " "))


def sentences(text: Column) -> Column:
    parts = F.filter(F.split(text, SENTENCE_BREAK), lambda s: s.rlike(r"(?U)\S"))
    return F.transform(parts, lambda s: F.btrim(s, F.lit(SENTENCE_TRIM)))


def _literal_sql(value) -> str:
    if isinstance(value, dict):
        return "map(" + ", ".join(f"{_literal_sql(k)}, {_literal_sql(v)}" for k, v in value.items()) + ")"
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(_literal_sql(v) for v in value) + ")"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value).lower() if isinstance(value, bool) else str(value)


def literal(value) -> Column:
    """A map, list or scalar constant, parsed in one step; Catalyst folds it."""
    return F.expr(_literal_sql(value))


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """A regex group, NULL when the pattern or the group did not match."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def first_where(items: Column, test) -> Column:
    """First element of an array that passes the test, else NULL."""
    return F.get(F.filter(items, test), 0)


def ordered_flags(*pairs) -> Column:
    """Array of the labels whose condition is true, in the given order."""
    return F.array_compact(F.array(*[F.when(condition, label) for condition, label in pairs]))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def is_unknown(column: Column, kind: str = "scalar") -> Column:
    """Unknown means NULL, an empty list, an empty text or an ``unknown`` component; False and 0 are known."""
    if kind == "array":
        return column.isNull() | (F.size(column) <= 0)
    if kind == "text":
        return column.isNull() | (column == "")
    if kind == "component":
        return column.isNull() | (column.getField("status") == "unknown")
    return column.isNull()


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is named; for nested lambdas, where Spark shares nothing."""
    return F.get(F.transform(F.array(value), use), 0)


def hold(column: Column) -> Column:
    """The same value, but a filter on it stays where it is written.

    Pushing a filter below a chain of projections copies the chain into the
    condition; for a rule at the end of a long chain that is the whole job again.
    """
    return F.when(F.spark_partition_id() >= 0, column)
