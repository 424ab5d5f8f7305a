"""Pairs are judged where they meet, and plans are read once."""

from pyspark.sql import functions as F

from fairlead.catalog import matching as cm
from fairlead.operators import digest as dg, notify as nt
from tests.test_whole_jobs import beside_sql, tables  # noqa: F401

ITEMS = (
    "profile_id string, item_id string, fingerprint string, change_class string, changed_fields array<string>, status string, priority_band string, "
    "title string, total_score int, seq long"
)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_decision_and_judgement_are_not_joined_again(spark, tables):  # noqa: F811
    good, _ = cm.assessments(spark, tables)
    both = [x for x in _plan(good).split("\n") if "Join" in x and "profile_id" in x and "opportunity_key" in x]
    assert len(both) == 1 and "LeftOuter" in both[0]  # the shared concepts of a pair
    for name in ("total_score", "priority_band", "notify_plan", "outbox", "outbox_items", "digest_rank", "heartbeat"):
        beside_sql(spark, tables, name)


def test_a_plan_says_what_two_passes_over_the_ledger_said(spark):
    of = lambda p, i, f, change, band, status="open": (p, i, f, change, ["status"], status, band, "t", 5, 1)
    rows = [
        of("a", "i1", "f1", "new", "exceptional"), of("a", "i1", "f2", "new", "strong_match", "closing_soon"), of("a", "i2", "f1", "known_unchanged", "strong_match"),
        of("a", "i3", "f1", "new", "exceptional"), of("a", "i4", "f1", "changed", "worth_checking"), of("a", "i4", "f1", "changed", "worth_checking"),
        of("a", "i5", "f1", "changed", "discovery"), of("b", "i6", None, "new", "exceptional"), of(None, "i7", "f1", "new", "exceptional"),
        of("b", None, "f1", "new", "exceptional"), of("b", "i8", "f8", "new", "low_priority"), of("b", "i9", "f9", "new", None), of("c", "i1", "f1", "new", "exceptional", "closed"),
        of("c", "i3", "f3", None, "strong_match"),
    ]
    sent = [("i3", "f1", "immediate_alert", "delivered"), ("i5", "f1", "daily_digest", "delivered"), ("i5", "f1", "daily_digest", "delivered"),
            ("i4", "f1", "immediate_alert", "failed"), ("i1", "f2", "daily_digest", "delivered"), ("i6", None, "immediate_alert", "delivered")]
    items = spark.createDataFrame(rows, ITEMS)
    ledger = spark.createDataFrame(sent, "item_id string, fingerprint string, notification_type string, delivery_status string")
    classed = nt.notify_class(items)
    now = nt.suppress(classed.where("is_immediate"), ledger, ["immediate_alert"])
    daily = nt.suppress(classed.where("is_daily"), ledger, ["daily_digest", "immediate_alert"])
    daily = daily.join(now.select("profile_id", "item_id"), ["profile_id", "item_id"], "left_anti")
    listed = lambda df, kind: [(r.profile_id, r.item_id, r.fingerprint, r.priority_band, kind or r.notification_type) for r in df.collect()]
    wanted = listed(now, "immediate_alert") + listed(daily, "daily_digest")
    planned = nt.notify_plan(items, ledger)
    assert sorted(map(str, listed(planned, None))) == sorted(map(str, wanted)) and len(wanted) > 8
    assert set(planned.columns) == {*items.columns, "is_immediate", "is_daily", "notification_type", "plan_id"}
    assert _plan(planned).count("Join") == 1
    plans = {r.notification_type: r for r in planned.where("profile_id = 'a'").collect()}
    alert = "\u001f".join(("immediate_alert", "a", plans["immediate_alert"].item_id, plans["immediate_alert"].fingerprint))
    ids = spark.range(1).select(F.sha2(F.lit(alert), 256).alias("x"), F.sha2(F.lit("daily_digest\u001fa"), 256).alias("y")).first()
    assert (plans["immediate_alert"].plan_id, plans["daily_digest"].plan_id) == (ids.x, ids.y)


def test_header_and_items_read_the_same_plan_rows(spark):
    columns = dict.fromkeys(nt._ITEM, "x") | {"seq": 1, "total_score": 5, "rolling_application": False, "deadline": None}
    layout = "seq long, total_score int, deadline timestamp, rolling_application boolean, " + ", ".join(
        f"{c} string" for c in nt._ITEM if c not in ("seq", "total_score", "deadline", "rolling_application"))
    planned = spark.createDataFrame([columns], layout).withColumns({
        "fingerprint": F.lit("f"), "change_class": F.lit("new"), "status": F.concat(F.lit("closing_"), F.lower(F.col("title")), F.lit("marker"))})
    header, items = nt.outbox(planned)
    assert "marker" not in _plan(header) + _plan(items) and (header.first().items, items.first().position) == (1, 1)


def test_ranks_keep_only_the_columns_asked_for(spark):
    rows = [("p", f"k{i}", i % 3, f"T{i % 2}") for i in range(20)]
    assessed = spark.createDataFrame(rows, "profile_id string, opportunity_key string, total_score int, title string").withColumns({
        c: F.lit(None).cast("string") for c in ("organization", "official_url", "application_url", "source_url")}).withColumn("deadline", F.lit(None).cast("timestamp"))
    whole, narrow = dg.digest_rank(assessed), dg.digest_rank(assessed, keep=("opportunity_key",))
    assert narrow.columns == ["profile_id", "opportunity_key", "rank"]
    pick = lambda df: {r.opportunity_key: r["rank"] for r in df.collect()}
    assert pick(whole) == pick(narrow) and {*whole.columns} >= {*assessed.columns, "rank_title"}
