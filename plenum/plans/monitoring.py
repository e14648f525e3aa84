"""Event log: usage, latency, errors, alerts and sessions; value stands for the latency."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plenum.operators.relops import distinct_on
from plenum.plans.registry import query

def error():
    return F.col("event_type") == "error"


@query("""SELECT count(*) AS calls, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE event_type = 'error') AS errors, round(quantile_cont(value, 0.95), 4) AS p95, round(100.0 * count(*) FILTER (WHERE event_type <> 'error') / count(*), 2) AS success FROM events""")
def headline(t):
    return t.events.agg(F.count("*").alias("calls"), F.count_distinct("user_id").alias("users"), F.count_if(error()).alias("errors"), F.round(F.percentile("value", 0.95), 4).alias("p95"), F.round(100.0 * F.count_if(~error()) / F.count("*"), 2).alias("success"))


@query("SELECT event_type, count(*) AS calls, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95 FROM events GROUP BY 1 ORDER BY calls DESC, event_type LIMIT 10")
def usage_by_tool(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("calls"), F.round(F.percentile("value", 0.5), 4).alias("p50"), F.round(F.percentile("value", 0.95), 4).alias("p95")).orderBy(F.desc("calls"), "event_type").limit(10)


@query("SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1")
def hourly_calls(t):
    return t.events.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"))


@query("SELECT user_id, event_id AS last_event, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) rn FROM events) WHERE rn = 1")
def latest_per_user(t):
    return distinct_on(t.events, ["user_id"], [F.desc_nulls_first("ts"), F.desc("event_id")]).select("user_id", F.col("event_id").alias("last_event"), "event_type")


@query("""WITH m AS (SELECT max(ts) AS now FROM events) SELECT event_type, count(*) FILTER (WHERE ts > now - INTERVAL 7 DAY) AS this_week, count(*) FILTER (WHERE ts <= now - INTERVAL 7 DAY AND ts > now - INTERVAL 14 DAY) AS last_week FROM events, m GROUP BY 1""")
def week_deltas(t):
    now = F.lit(t.events.agg(F.max("ts")).first()[0]).cast("timestamp_ntz")
    day = F.expr("INTERVAL 7 DAYS")
    return t.events.groupBy("event_type").agg(F.count_if(F.col("ts") > now - day).alias("this_week"), F.count_if((F.col("ts") <= now - day) & (F.col("ts") > now - day - day)).alias("last_week"))


WINDOWS = "w AS (SELECT event_id, user_id, ts, {five} AS total, {errors} AS errors, {fifteen} AS recent, {hour} AS hour_, {before} AS before, {p95} AS p95 FROM events)".format(
    five="count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 18000 PRECEDING AND CURRENT ROW)",
    errors="count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 18000 PRECEDING AND CURRENT ROW)",
    fifteen="count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 54000 PRECEDING AND 1 PRECEDING)",
    hour="count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 234000 PRECEDING AND 18001 PRECEDING)",
    p95="round(quantile_cont(value * 50, 0.95) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 18000 PRECEDING AND CURRENT ROW), 4)",
    before="count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 270000 PRECEDING AND 54001 PRECEDING)",
)


def trailing(events, unit=3600):
    """event_id and what the last 5 and 15 units, and the 60 before each, hold of its user's events. A unit is a minute in production, an hour here."""
    by = Window.partitionBy("user_id").orderBy(F.col("ts").cast("timestamp").cast("double"))
    n = lambda a, b: F.count("*").over(by.rangeBetween(a, b))
    p95 = F.round(F.percentile(F.col("value") * 50, 0.95).over(by.rangeBetween(-5 * unit, 0)), 4)
    bad = F.count(F.when(error(), 1)).over(by.rangeBetween(-5 * unit, 0))
    return events.select("event_id", "user_id", n(-5 * unit, 0).alias("total"), bad.alias("errors"), n(-15 * unit, -1).alias("recent"), n(-65 * unit, -5 * unit - 1).alias("hour_"), n(-75 * unit, -15 * unit - 1).alias("before"), p95.alias("p95"))


@query(f"WITH {WINDOWS} SELECT event_id, user_id, total, errors, recent, hour_, before, p95 FROM w")
def trailing_windows(t):
    return trailing(t.events)


@query(f"""WITH {WINDOWS} SELECT event_id, CASE WHEN total >= 5 AND errors * 1.0 / total > 0.10 THEN 'error_rate' WHEN p95 > 10000 THEN 'latency' WHEN hour_ > 0 AND total >= 5 AND total >= 3 * hour_ / 12.0 THEN 'traffic_spike' WHEN recent = 0 AND before >= 10 THEN 'silence' ELSE 'ok' END AS alert FROM w""")
def alert_rules(t):
    """The first rule that fires as of each event: over 10 % errors of five calls or more, a p95 of more than ten seconds, three times the hour's usual traffic, or nothing since ten calls in the hour before."""
    total, base = F.col("total"), F.col("hour_") / 12.0
    rule = F.when((total >= 5) & (F.col("errors") / total > 0.10), "error_rate").when(F.col("p95") > 10_000, "latency").when((base > 0) & (total >= 5) & (total >= 3 * base), "traffic_spike").when((F.col("recent") == 0) & (F.col("before") >= 10), "silence").otherwise("ok")
    return trailing(t.events).select("event_id", rule.alias("alert"))


@query("""WITH x AS (SELECT event_id, user_id, greatest(1, length(props) // 4) AS tokens, epoch(ts) AS s FROM events) SELECT event_id, CAST(sum(tokens) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 36000 PRECEDING AND CURRENT ROW) AS BIGINT) AS used, sum(tokens) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 36000 PRECEDING AND CURRENT ROW) <= 5 AS within FROM x""")
def token_budget(t):
    """Tokens that each user's last ten hours took, and whether they are within the budget."""
    tokens = F.greatest(F.lit(1), F.floor(F.length("props") / 4))
    used = F.sum(tokens).over(Window.partitionBy("user_id").orderBy(F.col("ts").cast("timestamp").cast("double")).rangeBetween(-36000, 0))
    return t.events.select("event_id", used.alias("used"), (used <= 5).alias("within"))


@query("""WITH old AS (SELECT l_orderkey AS k, l_partkey AS v, 'old' AS origin FROM lineitem), new AS (SELECT o_orderkey AS k, o_custkey AS v, 'new' AS origin FROM orders WHERE o_orderstatus = 'P') SELECT * FROM old WHERE k NOT IN (SELECT k FROM new) UNION ALL SELECT * FROM new""")
def replaced_rows(t):
    """Rows of replaced keys go, the new ones take their place."""
    from plenum.sinks import replaced

    row = lambda df, k, v, origin: df.select(F.col(k).alias("k"), F.col(v).alias("v"), F.lit(origin).alias("origin"))
    return replaced(row(t.lineitem, "l_orderkey", "l_partkey", "old"), row(t.orders.filter("o_orderstatus = 'P'"), "o_orderkey", "o_custkey", "new"), ["k"])


@query("""WITH s AS (SELECT doc_id, quality FROM labels), p AS (SELECT doc_id, 9 AS quality FROM documents WHERE lang = 'de') SELECT * FROM p UNION ALL SELECT * FROM s WHERE quality = 1 AND doc_id NOT IN (SELECT doc_id FROM p)""")
def promoted_rows(t):
    """Approved rows of staging that production lacks join it."""
    from plenum.sinks import promoted

    return promoted(t.labels.select("doc_id", "quality"), t.documents.filter("lang = 'de'").select("doc_id", F.lit(9).alias("quality")), "doc_id", F.col("quality") == 1)


@query("SELECT event_id, sha256(event_id || '|' || user_id || '|' || coalesce(props, '')) AS cell FROM events")
def audited_cells(t):
    from plenum.sinks import audited

    return audited(t.events.select("event_id", "user_id", "props"), ["event_id", "user_id"], "props").select("event_id", "cell")


@query("""WITH g AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k""")
def sessions(t):
    """Sessions that end after an hour of silence."""
    s = t.events.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("started"), "n")


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS last_hour FROM events")
def trailing_window(t):
    w = Window.partitionBy("user_id").orderBy(F.col("ts").cast("timestamp").cast("double")).rangeBetween(-3600, 0)
    return t.events.select("event_id", "user_id", F.count("*").over(w).alias("last_hour"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50")
def json_predicate(t):
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.filter(k > 50).select("event_id", k.alias("k"))


@query("SELECT event_id, sha256(props) AS params FROM events")
def audit_hash(t):
    return t.events.select("event_id", F.sha2("props", 256).alias("params"))
