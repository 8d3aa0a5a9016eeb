"""Patches of several edits: where each one hits, which exclude each other, the text after all of them, and replay of chains of commits.

An edit names its old text; it hits where that stands exactly once.  All edits of a patch refer to the text before any of them, so the
text after is put together from the stretches between the hits, in one pass, whatever order they were written in.  A patch applies as a
whole or not at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rounds of repair after which a patch comes too late.
ROUNDS = 2


def _hits(text: Column, old: Column) -> Column:
    return (F.char_length(text) - F.char_length(F.replace(text, old, F.lit("")))) / F.greatest(F.char_length(old), F.lit(1))


def located(edits: DataFrame, texts: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """``edits(patch, nth, id, old, new)`` with text, start, end and the fault of each, null if it has none.

    ``texts(id, text)``; ``allowed(patch, id)``, if given, has the blocks that a patch may change.  Overlaps are found by a sweep over the hits of a
    block: an edit that begins before an earlier one ends.
    """
    met = edits.hint("merge").join(texts.select("id", "text"), "id", "left")
    if allowed is not None:
        met = met.hint("merge").join(allowed.select("patch", "id").distinct().withColumn("may", F.lit(True)), ["patch", "id"], "left")
    else:
        met = met.withColumn("may", F.lit(True))
    old = F.col("old")
    fault = (
        F.when(F.coalesce(old, F.lit("")) == "", "no old text").when(old == F.col("new"), "no change").when(F.col("text").isNull(), "unknown block").when(F.col("may").isNull(), "not allowed")
        .when(F.contains(old, F.lit("\n")), "several lines").when(_hits(F.col("text"), old) != 1, "not unique")
    )
    found = met.withColumn("fault", fault).withColumn("start", F.when(F.col("fault").isNull(), F.expr("locate(old, text) - 1"))).withColumn("end", F.col("start") + F.char_length("old"))
    before = Window.partitionBy("patch", "id").orderBy("start", "nth").rowsBetween(Window.unboundedPreceding, -1)
    over = F.col("start").isNotNull() & (F.max("end").over(before) > F.col("start"))
    return found.withColumn("fault", F.when(over, "overlap").otherwise(F.col("fault"))).drop("may")


def verdicts(found: DataFrame, patches: DataFrame, states: DataFrame) -> DataFrame:
    """(patch, applied, fault): the first thing that is wrong with a patch: its base, its rounds, its digest, then its edits in order.

    ``patches(patch, material, base_revision, digest)``, ``states(material, revision, rounds, digest)``.
    """
    edits = found.where("fault IS NOT NULL").groupBy("patch").agg(F.min_by("fault", "nth").alias("of_edit"))
    n = found.groupBy("patch").agg(F.count("*").alias("n"))
    now = states.select("material", "revision", "rounds", F.col("digest").alias("now"))
    met = patches.hint("merge").join(now, "material", "left").hint("merge").join(edits, "patch", "left").hint("merge").join(n, "patch", "left")
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    fault = F.when(~same("base_revision", "revision"), "stale").when(F.col("rounds") >= ROUNDS, "too many rounds").when(~same("digest", "now"), "other text").when(F.col("n").isNull(), "no edits").otherwise(F.col("of_edit"))
    return met.select("patch", fault.isNull().alias("applied"), fault.alias("fault"))


def _woven(text: Column, hits: Column) -> Column:
    """A text with its sorted, disjoint hits (start, end, new) replaced."""
    ends = F.concat(F.array(F.lit(0)), F.transform(hits, lambda h: h["end"].cast("int")))
    head = F.transform(hits, lambda h, i: F.concat(F.substring(text, F.get(ends, i) + 1, h["start"].cast("int") - F.get(ends, i)), h["new"]))
    return F.concat(F.array_join(head, ""), F.substring(text, F.element_at(ends, -1) + 1, F.char_length(text)))


def applied(found: DataFrame, judged: DataFrame) -> DataFrame:
    """(patch, id, text): the blocks that applied patches change, after all edits."""
    good = found.hint("merge").join(judged.where("applied").select("patch"), "patch", "left_semi")
    hits = F.array_sort(F.collect_list(F.struct("start", "end", "new")))
    return good.groupBy("patch", "id").agg(F.first("text").alias("text"), hits.alias("hits")).select("patch", "id", _woven(F.col("text"), F.col("hits")).alias("text"))


def _let(value: Column, use) -> Column:
    """``use(value)``, where the value is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _places(text: Column, edits: Column) -> Column:
    """(start, end, new) of each edit in order; start is null where it doesn't hit once in its line."""

    def placed(lines: Column) -> Column:
        def place(e: Column) -> Column:
            line = F.get(lines, e["line"].cast("int") - 1)
            ahead = F.char_length(F.array_join(F.slice(lines, F.lit(1), F.greatest(e["line"].cast("int") - 1, F.lit(0))), "\n")) + F.when(e["line"] > 1, 1).otherwise(0)
            hit = (e["line"] >= 1) & line.isNotNull() & (e["old"] != "") & (_hits(line, e["old"]) == 1)
            start = F.when(hit, ahead + F.position(e["old"], line) - 1)
            return F.struct(start.alias("start"), (start + F.char_length(e["old"])).alias("end"), e["new"].alias("new"))

        return F.array_sort(F.transform(edits, place))

    return _let(F.split(text, "\n"), placed)


def _by_round(a: Column, b: Column) -> Column:
    return F.when(a["round"] < b["round"], -1).when(a["round"] > b["round"], 1).otherwise(0)


def _after_commit(now: Column, commit: Column) -> Column:
    """The text, whether the chain still holds, and the states so far, after one more commit."""

    def made(hits: Column) -> Column:
        clear = F.transform(hits, lambda h, i: h["start"].isNotNull() & ((i == 0) | F.coalesce(F.get(hits, i - 1)["end"] <= h["start"], F.lit(False))))
        fits = F.coalesce((F.size(hits) > 0) & F.forall(clear, lambda ok: ok), F.lit(False))
        return F.when(fits, _woven(now["text"], hits))

    def judged(after: Column) -> Column:
        return (
            F.when(~now["sound"], "broken").when(F.sha2(now["text"], 256) != commit["before"], "other text").when(after.isNull(), "edits don't fit")
            .when(F.sha2(after, 256) != commit["after"], "other result").otherwise("verified")
        )

    def moved(after: Column) -> Column:
        def told(state: Column) -> Column:
            good = state == "verified"
            entry = F.struct(commit["round"].alias("round"), state.alias("state"))
            return F.struct(F.when(good, after).otherwise(now["text"]).alias("text"), (now["sound"] & good).alias("sound"), F.concat(now["states"], F.array(entry)).alias("states"))

        return _let(judged(after), told)

    return _let(_let(_places(now["text"], commit["edits"]), made), moved)


def replayed(texts: DataFrame, commits: DataFrame, edits: DataFrame) -> DataFrame:
    """(id, round, state) of a chain of commits on each text: ``verified``, or why not.

    ``texts(id, text)`` before the first round, ``commits(id, round, before, after)`` with digests, ``edits(id, round, nth, line, old, new)``; lines count from 1.
    A commit is verified if the text that the earlier ones leave has the digest ``before``, each edit hits once in its line and none
    overlap, and the text after has the digest ``after``.  Behind one that is not, the chain is ``broken``.  Rounds without a commit are passed over.
    A text meets its whole chain in one join and is folded over it in its row, so it travels once, however many rounds there are.
    """
    edit = F.struct("nth", "line", "old", "new")
    of_round = edits.groupBy("id", "round").agg(F.array_sort(F.collect_list(edit)).alias("edits"))
    due = commits.where("round >= 1").select("id", "round", "before", "after").hint("merge").join(of_round, ["id", "round"], "left")
    commit = F.struct(F.col("round").cast("int").alias("round"), "before", "after", "edits")
    chains = due.groupBy("id").agg(F.array_sort(F.collect_list(commit), _by_round).alias("chain"))
    start = F.struct(F.col("text").alias("text"), F.lit(True).alias("sound"), F.array().cast("array<struct<round:int,state:string>>").alias("states"))
    met = texts.select("id", "text").hint("merge").join(chains, "id")
    return met.select("id", F.inline(F.aggregate("chain", start, _after_commit)["states"])).select("id", "round", "state")
