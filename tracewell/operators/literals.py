"""Many literal texts in many longer ones: a rare-gram index, and an automaton for what is too short for it.

Each literal of ``GRAM`` bytes or more is filed under one of its grams of that size, the one that the fewest literals have.  A text is
passed over once: a bit array of fixed size tells which of its grams may be filed, and only those leave the task, each once for a text.  An equi-join
with the index brings texts and literals together, whose whole comparison follows.  Shorter literals are found by Aho-Corasick automata,
broadcast in slices of ``SLICE`` literals.  So no plan compares every text with every literal, and no list is broadcast whole.

Edge cases: a null or empty literal is held by no text; a null text holds nothing; repeated literals count once; texts
may repeat their keys, also null ones, and are compared each by itself; either table may be empty.
"""

from __future__ import annotations

from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.binding import small
from tracewell.plans.staging import stage

#: Bytes of a gram, bits of the sieve, and short literals of an automaton.
GRAM, SIEVE_BITS, SLICE = 8, 1 << 25, 100_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(text: bytes) -> np.ndarray:
    """The grams of a text as numbers, one for each place: its bytes, eight at a time."""
    n = len(text) - GRAM + 1
    return np.ndarray((n,), dtype="<u8", buffer=text, strides=(1,)) if n > 0 else np.zeros(0, dtype="<u8")


def _bit(found: np.ndarray) -> np.ndarray:
    """The bit of each gram in the sieve."""
    with np.errstate(over="ignore"):
        mixed = (found ^ (found >> np.uint64(29))) * _MIX
    return (mixed >> np.uint64(64 - (SIEVE_BITS.bit_length() - 1))).astype(np.int64)


def _rows(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def gram_index(literals: DataFrame) -> DataFrame:
    """(literal, gram): each literal of ``literals(literal)`` that is long enough, with the gram that the fewest of them have."""

    def cut(batches):
        for batch in batches:
            for literal in batch.column("literal").to_pylist():
                own = np.unique(grams(literal.encode())).view(np.int64)
                yield _rows({"literal": pa.array([literal] * len(own)), "gram": pa.array(own)})

    each = stage(literals.where(F.octet_length("literal") >= GRAM).distinct().mapInArrow(cut, "literal string, gram long"), "grams")
    often = each.groupBy("gram").agg(F.count("*").alias("n"))
    rare = each.hint("merge").join(often, "gram").groupBy("literal").agg(F.min(F.struct("n", F.xxhash64("gram"), "gram")).alias("rarest"))
    return rare.select("literal", F.col("rarest.gram").alias("gram"))


def _sieve(index: DataFrame) -> np.ndarray:
    """A bit for each filed gram, put together by an aggregation of at most ``SIEVE_BITS / 64`` rows."""

    def bits(batches):
        for batch in batches:
            at = _bit(batch.column("gram").to_numpy().view(np.uint64))
            yield _rows({"word": pa.array(at >> 6), "bits": pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))})

    words = index.select("gram").mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(SIEVE_BITS // 64, dtype="<i8")
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint8)


def _filed(texts: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, literal): texts that have the gram of a literal."""
    shared = texts.sparkSession.sparkContext.broadcast(_sieve(index))
    schema = ", ".join([*(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in keys), "gram long"])

    def sift(batches):
        sieve = shared.value
        for batch in batches:
            found = []
            for text in batch.column("__text").to_pylist():
                own = grams(text or b"")
                at = _bit(own)
                found.append(np.unique(own[(sieve[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)]))
            place = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            flat = np.concatenate(found) if found else np.zeros(0, "<u8")
            yield _rows({k: batch.column(k).take(place) for k in keys} | {"gram": pa.array(flat.view(np.int64))})

    hits = stage(texts.mapInArrow(sift, schema), "hits")
    return hits.hint("merge").join(index, "gram").select(*keys, "literal")


def _short(texts: DataFrame, literals: DataFrame, keys: list[str]) -> DataFrame | None:
    """(keys, literal) of the literals too short for a gram, a pass over the texts for each slice of them."""
    schema = ", ".join([*(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in keys), "literal string"])
    context = texts.sparkSession.sparkContext

    def found_by(shared):
        def scan(batches):
            automaton = ahocorasick.Automaton()
            for literal in shared.value:
                automaton.add_word(literal, literal)
            automaton.make_automaton()
            for batch in batches:
                found = [sorted({x for _, x in automaton.iter(t.decode())}) if t else [] for t in batch.column("__text").to_pylist()]
                place = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
                yield _rows({k: batch.column(k).take(place) for k in keys} | {"literal": pa.array([x for own in found for x in own], pa.string())})

        return scan

    parts, held = [], []

    def search() -> None:
        shared = context.broadcast(list(held))
        parts.append(stage(texts.mapInArrow(found_by(shared), schema), "short"))
        shared.unpersist()
        held.clear()

    for row in literals.where(F.octet_length("literal").between(1, GRAM - 1)).distinct().toLocalIterator():
        held.append(row["literal"])
        if len(held) == SLICE:
            search()
    if held:
        search()
    return reduce(DataFrame.unionByName, parts) if parts else None


def held(texts: DataFrame, literals: DataFrame, keys: list[str], text: str = "text", literal: str = "literal") -> DataFrame:
    """Rows of ``texts`` with each ``literal`` that their text holds."""
    wanted = stage(literals.select(F.col(literal).cast("string").alias("literal")).where("literal <> ''").distinct(), "literals")
    sought = texts.where(F.col(text).isNotNull()).select(*keys, F.col(text).cast("binary").alias("__text"))
    index = stage(gram_index(wanted), "index")
    met, short = _filed(sought, index, keys), _short(sought, wanted, keys)
    met = stage((met if short is None else met.unionByName(short)).distinct(), "met").select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("literal").alias(literal))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    return texts.hint("merge").join(met, same).where(F.contains(text, F.col(literal))).drop(*(f"__{k}" for k in keys))


def held_words(texts: DataFrame, words: DataFrame, keys: list[str], text: str = "text", word: str = "literal", within: str = "[a-z]") -> DataFrame:
    """(keys, word) for each row of ``texts`` and each word in its text with no character of the class ``within`` next to it.

    A word of such characters alone is a whole run of them, and the empty word stands where neither side has one.  So each text is cut into its
    distinct runs once, which meet those words in an equi-join.  Words with other characters are ``held``, and their surroundings looked at.
    """
    wanted = stage(words.select(F.col(word).cast("string").alias(word)).where(F.col(word).isNotNull()).distinct(), "words")
    alone = F.col(word).rlike(f"\\A{within}*\\z")
    runs = F.regexp_extract_all(text, F.lit(f"{within}+"), F.lit(0))
    gaps = F.when(F.col(text).rlike(f"(?<!{within})(?!{within})"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    found = texts.select(*keys, F.explode(F.array_distinct(F.concat(runs, gaps))).alias(word)).hint("merge")
    met = found.join(small(wanted.where(alone)), word).select(*keys, word)
    others = wanted.where(~alone)
    if others.isEmpty():
        return met
    quoted = F.concat(F.lit(f"(?<!{within})\\Q"), F.replace(F.col(word), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(f"\\E(?!{within})"))
    return met.unionByName(held(texts, others, keys, text, word).withColumn("__shape", quoted).where(F.expr(f"rlike(`{text}`, __shape)")).select(*keys, word))
