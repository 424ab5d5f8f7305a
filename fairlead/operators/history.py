"""Identity, snapshots, deduplication, versions and state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fairlead.functions import text as tx, urls
from fairlead.operators import ordered

#: Fields whose change makes a new version (fixed values, in report order).
MEANINGFUL_FIELDS = (
    "status", "opening_date", "deadline", "application_url", "eligibility", "funding", "participation_mode",
    "program_family", "cycle_label", "cycle_year",
)


def snapshot(opps: DataFrame) -> Column:
    """The meaningful fields of a record; eligibility without its raw text."""
    fields = [
        F.col(name).dropFields("raw_text").alias(name) if name == "eligibility" else F.col(name)
        for name in MEANINGFUL_FIELDS if name in opps.columns
    ]
    return F.struct(*fields)


def fingerprint(snap: Column) -> Column:
    """Content hash; equal exactly when all fields are equal, NULLs included."""
    return F.sha2(F.to_json(snap, {"ignoreNullFields": "false"}), 256)


def _or_blank(*columns: Column) -> Column:
    return F.coalesce(*[tx.blank_to_null(c) for c in columns])


def dedup_key() -> Column:
    """Same organisation, title and cycle year; without an organisation, the same URL."""
    year = F.coalesce(
        F.year("deadline").cast("string"), F.year("program_start_date").cast("string"),
        F.year("opening_date").cast("string"), tx.first_group(F.col("title"), r"(?U)\b(20\d{2})\b"), F.lit("unknown"),
    )
    by_name = F.concat_ws(
        "\u001f", F.lit("identity"), tx.norm_identity(F.col("organization")), tx.norm_identity(F.col("title")), year
    )
    target = _or_blank(F.col("application_url"), F.col("official_url"), F.col("source_url"))
    return F.when(tx.blank_to_null(F.col("organization")).isNotNull(), by_name).otherwise(
        F.concat_ws("\u001f", F.lit("url"), urls.canonical_url(target))
    )


def history_key() -> Column:
    cycle = F.coalesce(F.nullif(F.col("cycle_year"), F.lit(0)).cast("string"), tx.blank_to_null(F.col("cycle_label")), F.lit("unknown"))
    return F.concat(urls.canonical_url(_or_blank(F.col("official_url"), F.col("source_url"))), F.lit("::"), cycle)


def dedup(opps: DataFrame, seq: str = "seq", key: Column | None = None, scope: list[str] | None = None):
    """Survivors (first of each key in run order) and the other source URLs seen for them.

    The duplicates stay rows ``(dedup_key, duplicate_source_url)``: a programme
    copied a million times never becomes one wide record. Both outputs combine
    map-side; ``scope`` columns (a run, a profile) keep keys apart.
    """
    scope = scope or []
    keyed = opps.withColumn("dedup_key", dedup_key() if key is None else key)
    keys = [*scope, "dedup_key"]
    rest = [c for c in keyed.columns if c not in keys]
    survivors = ordered.first_per_key(keyed, keys, F.struct(F.col(seq), F.col("source_url")), rest)
    kept = survivors.select(*keys, F.col("source_url").alias("_kept"))
    others = keyed.select(*keys, F.col("source_url").alias("duplicate_source_url")).distinct()
    duplicates = others.join(kept, keys).where(F.col("duplicate_source_url") != F.col("_kept")).drop("_kept")
    return survivors, duplicates


def latest_record(opps: DataFrame) -> DataFrame:
    """One record per page: the newest snapshot's, equal times settled by content."""
    keyed = opps.withColumn("_content", F.xxhash64(*opps.columns))
    newest = keyed.groupBy("opportunity_key").agg(
        F.max(F.struct(F.coalesce(F.col("last_verified_at").cast("timestamp"), F.lit(0).cast("timestamp")), "seq", "_content")).alias("_top")
    )
    picked = newest.select("opportunity_key", F.col("_top._content").alias("_content"))
    return keyed.join(picked, ["opportunity_key", "_content"], "left_semi").drop("_content").dropDuplicates(["opportunity_key"])


def duplicate_evidence(duplicates: DataFrame) -> DataFrame:
    """Duplicate source URLs in the evidence layout."""
    return duplicates.select(
        "dedup_key", F.lit("duplicate_source_url").alias("field"), F.col("duplicate_source_url").alias("value"),
        F.col("duplicate_source_url").alias("source_url"), F.lit("high").alias("confidence"),
        F.lit("duplicate input for the same programme cycle").alias("evidence_text"),
    )


def change_track(observations: DataFrame, key: str, seq: str, fields: list[str], width: int = ordered.BUCKET) -> DataFrame:
    """Adds change_class, changed_fields and version_number to each observation, in arrival order per key.

    An unchanged observation equals the latest version, so comparing with the
    previous observation is comparing with the latest version.
    """
    packed = observations.withColumn("_now", F.struct(*fields))
    rows = ordered.with_previous(packed, key, seq, "_now", "_was", width)
    moved = F.array_compact(F.array(*[
        F.when(F.col("_was_missing") | ~F.col(f"_now.{f}").eqNullSafe(F.col(f"_was.{f}")), F.lit(f)) for f in fields
    ]))
    rows = rows.withColumn("changed_fields", moved)
    rows = rows.withColumn(
        "change_class",
        F.when(F.col("_was_missing"), "new").when(F.size("changed_fields") > 0, "changed").otherwise("known_unchanged"),
    ).drop("_now", "_was", "_was_missing")
    return ordered.running_count(rows, key, seq, F.col("change_class") != "known_unchanged", "version_number", width)


def versions(tracked: DataFrame) -> DataFrame:
    """Only the observations that start a version."""
    return tracked.where(F.col("change_class") != "known_unchanged")


def track_against(state: DataFrame, opps: DataFrame, key: str, seq: str, fields: list[str]) -> DataFrame:
    """Change tracking of new observations on top of stored latest snapshots (``key``, fields, ``version_number``)."""
    old = state.select(key, *fields, F.lit(-1).cast("long").alias(seq), F.col("version_number").alias("_stored"))
    new = opps.withColumn("_stored", F.lit(None).cast("long"))
    both = new.unionByName(old, allowMissingColumns=True)
    tracked = change_track(both, key, seq, fields)
    stored = state.select(key, F.col("version_number").alias("_base"))
    rows = tracked.where(F.col("_stored").isNull()).drop("_stored").join(stored, key, "left")
    shift = F.when(F.col("_base").isNull(), F.col("version_number")).otherwise(F.col("version_number") - 1 + F.col("_base"))
    return rows.withColumn("version_number", shift).drop("_base")


def next_state(tracked: DataFrame, key: str, seq: str, fields: list[str], state: DataFrame | None = None) -> DataFrame:
    """The state that the next run tracks against: ``key``, the latest fields, ``version_number``; keys not seen stay as they were."""
    latest = tracked.groupBy(key).agg(F.max_by(F.struct(*fields, "version_number"), seq).alias("_s")).select(key, "_s.*")
    return latest if state is None else state.select(latest.columns).join(latest.select(key), key, "left_anti").unionByName(latest)


def state_fold(observations: DataFrame, key: str, seq: str, seen_at: str, first_wins: list[str], last_wins: list[str],
               state: DataFrame | None = None) -> DataFrame:
    """One row per key: first/last seen, first source kept, everything else from the last observation."""
    shaped = observations.select(
        key, F.col(seq).cast("long").alias("_seq"), F.col(seen_at).alias("_from"), F.col(seen_at).alias("_to"),
        *first_wins, *last_wins,
    )
    if state is not None:
        shaped = shaped.unionByName(state.select(
            key, F.lit(-1).cast("long").alias("_seq"), F.col("first_seen_at").alias("_from"),
            F.col("last_seen_at").alias("_to"), *first_wins, *last_wins,
        ))
    return shaped.groupBy(key).agg(
        F.min_by("_from", "_seq").alias("first_seen_at"), F.max_by("_to", "_seq").alias("last_seen_at"),
        *[F.min_by(c, "_seq").alias(c) for c in first_wins], *[F.max_by(c, "_seq").alias(c) for c in last_wins],
    )


def provenance_fold(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """First and last discovery per provenance key."""
    return rows.groupBy(*keys).agg(F.min(at).alias("first_discovered_at"), F.max(at).alias("last_discovered_at"))


def precedence_merge(items: DataFrame, keys: list[str], seq: str, change: str = "change_class") -> DataFrame:
    """One item per key: new over changed over unchanged, the first arrival on ties."""
    standing = F.when(F.col(change) == "new", 2).when(F.col(change) == "changed", 1).otherwise(0)
    rest = [c for c in items.columns if c not in keys]
    return ordered.first_per_key(items, keys, F.struct((-standing).alias("p"), F.col(seq).alias("s")), rest)


def fold_attempts(attempts: DataFrame, keys: list[str], seq: str, at: str, delivered: Column, error: Column | None = None) -> DataFrame:
    """Delivery ledger: attempts, first and last success, last status and error."""
    error = F.lit(None).cast("string") if error is None else error
    shaped = attempts.select(*keys, F.col(seq).alias("_seq"), F.col(at).alias("_at"), delivered.alias("_ok"), error.alias("_error"))
    sent = F.when(F.col("_ok"), F.col("_at"))
    first = F.min_by("_at", F.when(F.col("_ok"), F.col("_seq")))
    last = F.max_by("_at", F.when(F.col("_ok"), F.col("_seq")))
    return shaped.withColumn("_sent", sent).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("attempts"),
        F.when(F.bool_or("_ok"), first).alias("first_sent_at"), F.when(F.bool_or("_ok"), last).alias("last_sent_at"),
        F.max_by("_at", "_seq").alias("last_attempted_at"),
        F.when(F.max_by("_ok", "_seq"), "delivered").otherwise("failed").alias("delivery_status"),
        F.max_by("_error", "_seq").alias("error"),
    )
