"""Cost ledger: usage, estimates, reservations, settlements, totals."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.sequence import folded

# Spellings of token counts in usage bodies, in order of preference.
INPUT_PATHS = ("$.prompt_tokens", "$.input_tokens", "$.inputTokens")
OUTPUT_PATHS = ("$.completion_tokens", "$.output_tokens", "$.outputTokens")
HIT_PATHS = ("$.prompt_cache_hit_tokens", "$.cache_read_input_tokens", "$.prompt_tokens_details.cached_tokens")


def normal_usage(body: Column) -> Column:
    """Struct (input, cache_hit, cache_miss, output, complete); hits are capped at the input, negatives unknown."""

    def first(paths) -> Column:
        value = F.coalesce(*(F.try_variant_get(body, p, "long") for p in paths))
        return F.when(value >= 0, value)

    tokens, out = first(INPUT_PATHS), first(OUTPUT_PATHS)
    hit = F.least(F.coalesce(first(HIT_PATHS), F.lit(0)), tokens)
    return F.struct(tokens.alias("input"), hit.alias("cache_hit"), (tokens - hit).alias("cache_miss"), out.alias("output"), (tokens.isNotNull() & out.isNotNull()).alias("complete"))


def cost(hit: Column, miss: Column, out: Column, rate_hit: Column, rate_miss: Column, rate_out: Column) -> Column:
    """Cost of a call at rates for a million tokens; null if anything is unknown or a rate is negative."""
    known = (rate_hit >= 0) & (rate_miss >= 0) & (rate_out >= 0)
    return F.when(known, (hit * rate_hit + miss * rate_miss + out * rate_out) / 1_000_000)


def settled(calls: DataFrame, settlements: DataFrame) -> DataFrame:
    """Calls with the status and amount of their first settlement; an unknown amount keeps the reservation."""
    first = settlements.groupBy("call_id").agg(F.min_by("actual", "ts").alias("actual"), F.count("*").alias("settlements"))
    met = calls.join(first, "call_id", "left")
    status = F.when(F.col("settlements").isNull(), "reserved").when(F.col("actual").isNull(), "unknown").when(F.col("actual") < 0, "rejected").otherwise("settled")
    return met.withColumn("status", status)


def summary(costs: DataFrame, keys: list[str]) -> DataFrame:
    """Known, reserved (unsettled) and unknown amounts; the unknown amount is null while any is unknown."""
    return costs.groupBy(*keys).agg(
        F.sum(F.when(F.col("status") == "settled", F.col("actual"))).alias("known"),
        F.sum(F.when(F.col("status") != "settled", F.col("reserved"))).alias("reserved"),
        F.count_if(F.col("status") == "settled").alias("settled_calls"),
        F.count_if(F.col("status") == "unknown").alias("unknown_calls"),
    )


def admitted(requests: DataFrame, budget: float, calls: int) -> DataFrame:
    """Reservations in request order: (scope, call_id, reason), reason null if admitted.

    A rejected request consumes nothing, so admission is a fold per scope.
    """

    def step(state, values):
        (used, seen), (call, amount) = state, values  # at most `calls` admitted ones are held
        reason = "duplicate" if call in seen else "negative" if amount < 0 else "calls" if len(seen) >= calls else "budget" if used + amount > budget + 1e-9 else None
        return ((used + amount, seen | {call}) if reason is None else (used, seen)), reason

    narrow = requests.select("scope", "call_id", "ts", "amount")
    return folded(narrow, ["scope"], ["ts", "call_id"], ["call_id", "amount"], lambda: (0.0, frozenset()), step, "reason", ("string", pa.string())).select("scope", "call_id", "reason")


def day_budget(calls: DataFrame) -> DataFrame:
    """Paid calls and spending per UTC day."""
    return calls.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("calls"), F.sum("amount").alias("amount"))


def receipts(requests: DataFrame) -> DataFrame:
    """Idempotent requests: per (project, request id) replay or conflict, with the first result."""
    found = requests.groupBy("project", "request_id").agg(F.count_distinct(F.sha2("payload", 256)).alias("signatures"), F.count("*").alias("n"), F.min_by("result", F.struct("ts", "result")).alias("result"))
    state = F.when(F.col("signatures") > 1, "conflict").when(F.col("n") > 1, "replay").otherwise("new")
    return found.select("project", "request_id", state.alias("state"), "result")


def running_share(rows: DataFrame, keys: list[str], order: list, amount: str) -> DataFrame:
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("spent", F.sum(amount).over(so_far))
