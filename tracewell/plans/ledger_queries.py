"""Queries of the cost ledger: orders are reservations, their lines settlements, events usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import ledger as op
from tracewell.registry import query
from tracewell.sources.model import table


def _usage(spark, sf_dir):
    """Usage bodies from events: spellings differ by event type."""
    name = F.when(F.col("event_type") == "view", "prompt_tokens").when(F.col("event_type") == "click", "input_tokens").otherwise("inputTokens")
    k = F.get_json_object("props", "$.k").cast("long")
    body = F.concat(F.lit('{"'), name, F.lit('": '), k * 10, F.lit(', "output_tokens": '), k, F.lit(', "prompt_cache_hit_tokens": '), k * 20 - 500, F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.parse_json(body).alias("body"))


_USAGE = (
    "k AS (SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events), "
    "usage AS (SELECT event_id, user_id, k * 10 AS input, least(CASE WHEN k * 20 - 500 >= 0 THEN k * 20 - 500 ELSE 0 END, k * 10) AS cache_hit, k AS output FROM k)"
)


@query(f"WITH {_USAGE} SELECT event_id, input, cache_hit, input - cache_hit AS cache_miss, output, true AS complete FROM usage")
def l01_usage(spark, sf_dir):
    return _usage(spark, sf_dir).select("event_id", op.normal_usage(F.col("body")).alias("u")).select("event_id", "u.*")


@query(f"WITH {_USAGE} SELECT user_id, round(sum((cache_hit * 0.5 + (input - cache_hit) * 2.0 + output * 8.0) / 1000000), 8) AS cost, round(sum((input * 2.0 + output * 8.0) / 1000000), 8) AS upper_bound FROM usage GROUP BY user_id")
def l02_cost_estimate(spark, sf_dir):
    u = _usage(spark, sf_dir).select("user_id", op.normal_usage(F.col("body")).alias("u")).select("user_id", "u.*")
    rates = (F.lit(0.5), F.lit(2.0), F.lit(8.0))
    own = op.cost(F.col("cache_hit"), F.col("cache_miss"), F.col("output"), *rates)
    bound = op.cost(F.lit(0), F.col("input"), F.col("output"), *rates)
    return u.groupBy("user_id").agg(F.round(F.sum(own), 8).alias("cost"), F.round(F.sum(bound), 8).alias("upper_bound"))


@query("SELECT o_orderpriority AS channel, sha256(o_orderpriority || '|' || min(o_totalprice)::DECIMAL(18, 2) || '|' || max(o_totalprice)::DECIMAL(18, 2)) AS snapshot_id, count(*) AS calls FROM orders GROUP BY o_orderpriority")
def l03_price_snapshots(spark, sf_dir):
    fixed = lambda c: c.cast("decimal(18,2)").cast("string")
    found = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("channel")).agg(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.count("*").alias("calls"))
    return found.select("channel", F.sha2(F.concat_ws("|", "channel", fixed(F.col("low")), fixed(F.col("high"))), 256).alias("snapshot_id"), "calls")


_CALLS = (
    "s AS (SELECT l_orderkey AS call_id, min(CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_extendedprice END) AS actual, min(l_shipdate) AS ts FROM lineitem GROUP BY l_orderkey, l_shipdate), "
    "f AS (SELECT call_id, arg_min_null(actual, ts) AS actual, count(*) AS n FROM s GROUP BY call_id), "
    "calls AS (SELECT o.o_custkey AS project, o.o_orderkey AS call_id, o.o_totalprice AS reserved, f.actual, CASE WHEN n IS NULL THEN 'reserved' WHEN f.actual IS NULL THEN 'unknown' ELSE 'settled' END AS status FROM orders o LEFT JOIN f ON f.call_id = o.o_orderkey)"
)


def _settled(spark, sf_dir):
    """Orders as reservations; the lines of a shipping day are one settlement, of unknown amount if all were returned."""
    calls = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("call_id"), F.col("o_totalprice").alias("reserved"))
    amount = F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice"))
    days = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("call_id"), F.col("l_shipdate").alias("ts")).agg(F.min(amount).alias("actual"))
    return op.settled(calls, days)


@query(f"WITH {_CALLS} SELECT project, round(sum(actual) FILTER (status = 'settled'), 2) AS known, round(sum(reserved) FILTER (status <> 'settled'), 2) AS reserved, count(*) FILTER (status = 'settled') AS settled_calls, count(*) FILTER (status = 'unknown') AS unknown_calls FROM calls GROUP BY project")
def l04_cost_summary(spark, sf_dir):
    found = op.summary(_settled(spark, sf_dir), ["project"])
    return found.withColumns({c: F.round(c, 2) for c in ("known", "reserved")})


@query(
    "WITH RECURSIVE c AS (SELECT o_custkey AS scope, o_orderkey AS call_id, o_totalprice::DOUBLE AS amount, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders), "
    "r AS (SELECT scope, 0::BIGINT AS rn, 0::BIGINT AS call_id, 0::DOUBLE AS used, 0 AS n, NULL::VARCHAR AS reason FROM (SELECT DISTINCT scope FROM c) UNION ALL SELECT scope, rn, call_id, CASE WHEN why IS NULL THEN used + amount ELSE used END, "
    "CASE WHEN why IS NULL THEN n + 1 ELSE n END, why FROM (SELECT c.scope, c.rn, c.call_id, c.amount, r.used, r.n, CASE WHEN c.amount < 0 THEN 'negative' WHEN r.n >= 8 THEN 'calls' WHEN r.used + c.amount > 1000000.0 + 1e-9 THEN 'budget' END AS why "
    "FROM r JOIN c ON c.scope = r.scope AND c.rn = r.rn + 1)) SELECT scope, call_id, reason FROM r WHERE rn > 0"
)
def l05_admission(spark, sf_dir):
    """An ordered fold in which rejected requests consume nothing."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scope"), F.col("o_orderkey").alias("call_id"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").cast("double").alias("amount"))
    return op.admitted(rows, 1_000_000.0, 8)


@query(f"WITH {_CALLS} SELECT call_id, status, actual FROM calls")
def l06_settlement(spark, sf_dir):
    return _settled(spark, sf_dir).select("call_id", "status", "actual")


@query("SELECT o_custkey AS material, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS actual, count(*) FILTER (o_orderstatus <> 'F') AS unknown, CASE WHEN count(*) FILTER (o_orderstatus <> 'F') = 0 THEN round(sum(o_totalprice), 2) END AS total FROM orders GROUP BY o_custkey")
def l07_material_costs(spark, sf_dir):
    done = F.col("o_orderstatus") == "F"
    found = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("material")).agg(F.round(F.sum(F.when(done, F.col("o_totalprice"))), 2).alias("actual"), F.count_if(~done).alias("unknown"), F.round(F.sum("o_totalprice"), 2).alias("every"))
    return found.select("material", "actual", "unknown", F.when(F.col("unknown") == 0, F.col("every")).alias("total"))


@query("SELECT user_id AS run, count(*) AS attempted, count(*) FILTER (event_type = 'purchase') AS verified, bool_and(event_type = 'purchase') AS all_verified, epoch(max(ts))::BIGINT - epoch(min(ts))::BIGINT AS span FROM events GROUP BY user_id")
def l09_run_report(spark, sf_dir):
    bought = F.col("event_type") == "purchase"
    found = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run")).agg(F.count("*").alias("attempted"), F.count_if(bought).alias("verified"), F.bool_and(bought).alias("all_verified"), F.max("ts").alias("last"), F.min("ts").alias("first"))
    return found.select("run", "attempted", "verified", "all_verified", (F.round(F.unix_micros(F.col("last").cast("timestamp")) / 1e6) - F.round(F.unix_micros(F.col("first").cast("timestamp")) / 1e6)).cast("long").alias("span"))


@query("SELECT user_id AS project, event_type AS request_id, CASE WHEN count(DISTINCT props) > 1 THEN 'conflict' WHEN count(*) > 1 THEN 'replay' ELSE 'new' END AS state, arg_min(event_id, (ts, event_id)) AS result FROM events GROUP BY user_id, event_type")
def v15_request_receipts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("project"), F.col("event_type").alias("request_id"), F.col("props").alias("payload"), F.col("event_id").alias("result"), "ts")
    return op.receipts(rows)
