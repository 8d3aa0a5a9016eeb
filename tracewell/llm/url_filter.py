"""URL filters as a sort-merge range join, in DataFrame operations only.

A host becomes a canonical key, its labels reversed and each ended by a dot
(``www.example.com`` -> ``com.example.www.``), so that a rule for a host and all its subdomains
is one interval of keys.  The ends of all intervals, with the stack of rules active from there
on, are merged into the sorted hosts; a sweep carries the latest stack to every host, and the
path picks the longest rule of the stack that fits.

How it scales.  The sweep runs over distinct hosts, so one hot host is one row.  Hosts and
interval ends are dealt by range and written with their partition; each partition sweeps for
itself, beginning with the stack that the partitions before it left open (one row per
partition is carried).  Rules are joined to their enclosing rules by key, never all with all.
The verdict returns to the URLs by a join on the host, which skew handling may split, as only
the host side is unique.

Edge cases: a null URL, or one without ``://``, has empty host and path and no rule; ports and
user names stay part of the host; rules that repeat count once (among equal rules with different
verdicts, block wins); an empty rule table leaves the default verdict; an empty URL table gives
no rows; other columns of the input are kept, but for clashes with the four new ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.plans.staging import stage

DEFAULT_VERDICT = "allow"
RULES_SCHEMA = "rule_host string, rule_path string, rule_verdict string"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``."""
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return urls.withColumn("host", F.translate(host, _UPPER, _LOWER)).withColumn("path", path)


def host_key(host) -> F.Column:
    """Labels reversed, each ended by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _after(key) -> F.Column:
    """The first key behind all keys that begin with ``key`` (which ends with a dot)."""
    return F.concat(F.substring(key, F.lit(1), F.length(key) - 1), F.lit("/"))


def interval_ends(rules: DataFrame) -> DataFrame:
    """(key, stack): where the active rules change, and the rules active from there on."""
    clean = rules.select(F.translate("rule_host", _UPPER, _LOWER).alias("h"), F.coalesce("rule_path", F.lit("")).alias("p"), F.col("rule_verdict").alias("v")).where("h is not null and v is not null")
    once = clean.groupBy("h", "p").agg(F.max("v").alias("v"))  # 'block' > 'allow'
    own = once.groupBy(host_key(F.col("h")).alias("key")).agg(F.collect_list(F.struct((F.length("h") + F.length("p")).alias("size"), F.concat("h", "p").alias("rule"), F.col("p").alias("path"), F.col("v").alias("verdict"))).alias("rules"))
    own = stage(own, "rules")
    # a rule's enclosing keys are its own leading labels
    labels = F.split("key", r"\.", -1)
    heads = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))
    pairs = own.select("key", F.explode(heads).alias("outer")).hint("merge").join(own.select(F.col("key").alias("outer"), F.col("rules").alias("held")), "outer")
    stacks = pairs.groupBy("key").agg(F.flatten(F.collect_list("held")).alias("open"), F.flatten(F.collect_list(F.when(F.col("outer") != F.col("key"), F.col("held")).otherwise(F.array().cast(own.schema["rules"].dataType)))).alias("closed"))
    starts = stacks.select("key", F.lit(1).alias("is_start"), F.col("open").alias("stack"))
    ends = stacks.select(_after(F.col("key")).alias("key"), F.lit(0).alias("is_start"), F.col("closed").alias("stack"))
    return starts.unionByName(ends).groupBy("key").agg(F.max_by("stack", "is_start").alias("stack"))


def swept(hosts: DataFrame, rules: DataFrame, partitions: int) -> DataFrame:
    """(host, stack) for every row of ``hosts(host)``: the rules active at each host."""
    ends = interval_ends(rules)
    sites = hosts.select(host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "host", F.lit(None).cast(ends.schema["stack"].dataType).alias("stack"))
    marks = ends.select("key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"), "stack")
    dealt = stage(sites.unionByName(marks).repartitionByRange(partitions, "key", "kind").withColumn("part", F.spark_partition_id()), "sweep")
    last = dealt.groupBy("part").agg(F.max_by("stack", F.when(F.col("kind") == 0, F.col("key"))).alias("left_open"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("part", F.last("left_open", ignorenulls=True).over(before).alias("carried"))
    order = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = dealt.hint("merge").join(carried, "part").withColumn("active", F.coalesce(F.last("stack", ignorenulls=True).over(order), "carried"))
    return swept.where("kind = 1").select("host", F.col("active").alias("stack"))


def judged(urls: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT, partitions: int | None = None) -> DataFrame:
    """``urls`` with host, path, rule (null if none fits) and verdict."""
    partitions = partitions or int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = parsed(urls.drop("host", "path", "rule", "verdict"))
    sites = swept(split.select("host").distinct(), rules, partitions).select(F.col("host").alias("__host"), F.col("stack").alias("__stack"))
    fitting = F.filter("__stack", lambda r: F.col("path").startswith(r["path"]))
    best = F.array_max(F.transform(fitting, lambda r: F.struct(r["size"].alias("size"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    met = split.hint("merge").join(sites, F.col("host") == F.col("__host"), "left").withColumn("__best", best)
    return met.withColumn("rule", F.col("__best.rule")).withColumn("verdict", F.coalesce("__best.verdict", F.lit(default))).drop("__host", "__stack", "__best")
