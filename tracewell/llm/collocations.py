"""Phrase collocation mining: counting in burst tries, spilled as sorted runs and merged by prefix.

Texts are cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and pieces into words ``[^\\x20\\x09]+``, A-Z lower-cased.
Everything is counted for each language apart.  A phrase of 2 to ``LONGEST`` words that occurs ``MIN_COUNT`` times or
more is a candidate.  Cut after its first words into two parts that occur l and r times, it scores ``1000 a n div (l r)``, where
a is its own count and n the number of words; its lowest cut counts.  A candidate goes if a longer one holds it and is
(nearly) as frequent.

Counting.  Each task counts phrases in a trie of word ids: below the root hang hash containers, one for each first
word, that map the rest of a phrase to its count; a container of more than ``BURST`` entries bursts into one
container for each next word.  When the trie has ``MAX_ENTRIES`` phrases (or ``MAX_WORDS`` word ids), whole
subtrees, largest first, leave it until half of it is left: as sorted and compressed runs of (phrase, count), one for each prefix partition.  A
prefix is the first two words, so no partition gets all phrases of a frequent first word.  A partition's runs are merged and summed in one
task, which returns frequent phrases only.

Which phrases are counted at all.  No part of a candidate is rarer than the candidate.  So words are counted first,
then pairs of frequent words, then phrases of three to five words all of whose neighbours are frequent pairs.
Frequent words and pairs are told by a bit array of ``FILTER_BITS`` bits, put together by an aggregation whose rows
are at most its words: broadcast, of one size at any scale.  A wrong bit costs time, not counts: phrases are counted
and merged under their words, and rare ones are dropped by their count.

Edge cases: a null text has no words; a null language is ``und``; repeated rows count as often as they stand; a
word of any length is a word; an empty table gives no rows; fewer candidates than ``top`` are all returned; other columns
(and whatever doc_id is) are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.words import mixed, text_batches
from tracewell.plans.staging import stage

#: Occurrences of a candidate, words of the longest one, and rows for each language.
MIN_COUNT, LONGEST, TOP = 100, 5, 2000
#: Per cent of a candidate's occurrences at which a longer one that holds it replaces it.
HELD_SHARE = 100
#: Entries after which a container bursts, phrases of a trie, and different words of a task's vocabulary.
BURST, MAX_ENTRIES, MAX_WORDS = 4_096, 400_000, 400_000
#: Bits of the filter of frequent words and pairs.
FILTER_BITS = 1 << 26
#: Words of a batch that are counted together.
WORDS_AT_ONCE = 1 << 21

#: Prefix partitions: one for so many words of the corpus, between these bounds.
WORDS_PER_PART, LEAST_PARTS, MOST_PARTS = 1_000_000, 64, 65_536

_BREAK = 0
_FOLDED = bytes(10 if chr(b) in ".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b < 91 else b for b in range(256))
#: The score of a cut, exact up to 38 digits.
EXACT_SCORE = "CAST(CAST(1000 * CAST(a AS DECIMAL(18, 0)) AS DECIMAL(21, 0)) * CAST(n AS DECIMAL(16, 0)) AS DECIMAL(38, 0)) DIV CAST(CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0)) AS DECIMAL(38, 0))"
_COUNTS = "lang string, n_words int, phrase string, n long"


def pieces(text: bytes | None) -> list[list[bytes]]:
    """The words of each piece of a text; pieces without words are left out."""
    cut = ((text or b"").translate(_FOLDED)).split(b"\n")
    return [words for words in map(bytes.split, cut) if words]


class Vocabulary(dict):
    """word -> id from 1 on; 0 parts pieces.  Knows a hash of each word."""

    def __init__(self):
        super().__init__({b"": _BREAK})
        self.words, self.hashes = [b""], [0]

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.words)
        self.words.append(word)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return number


class BurstTrie:
    """Counts of phrases of word ids: hash containers under a shallow trie.

    A container maps the rest of a phrase (a tuple of ids) to its count.  One that grows too large becomes a node, a
    dict from the next word's id to a container; a phrase that ends at a node is counted under ``_BREAK``.
    """

    def __init__(self, burst: int = BURST):
        self.burst, self.entries = burst, 0
        self.root: dict[int, dict] = {}
        self.nodes: set[int] = set()  # id() of the dicts that have burst
        self.sizes: Counter = Counter()  # entries under each first word

    def add(self, first: int, rests: list[tuple], counts: list[int]) -> None:
        """Adds phrases that begin with the same word."""
        before = self.entries
        holder = self.root.setdefault(first, {})
        if id(holder) not in self.nodes:
            self._count(holder, rests, counts)
            if len(holder) > self.burst and first != _BREAK:
                self.root[first] = self._burst(holder)
        else:
            below: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
            for rest, n in zip(rests, counts):
                own = below[rest[0] if rest else _BREAK]
                own[0].append(rest[1:])
                own[1].append(n)
            for word, (own, n) in below.items():
                self._count(holder.setdefault(word, {}), own, n)
        self.sizes[first] += self.entries - before

    def _count(self, container: dict, rests: list[tuple], counts: list[int]) -> None:
        before, get = len(container), container.get
        for rest, n in zip(rests, counts):
            container[rest] = get(rest, 0) + n
        self.entries += len(container) - before

    def _burst(self, container: dict) -> dict:
        node: dict[int, dict] = {}
        for rest, n in container.items():
            node.setdefault(rest[0] if rest else _BREAK, {})[rest[1:]] = n
        self.nodes.add(id(node))
        return node

    def spill(self, until: int) -> Iterator[tuple[tuple, dict]]:
        """Takes out whole subtrees, largest first, until so many entries are left: (first words, container of what follows)."""
        for first, size in self.sizes.most_common():
            if self.entries <= until:
                break
            holder = self.root.pop(first)
            del self.sizes[first]
            self.entries -= size
            head = (first,) if first != _BREAK else ()
            if id(holder) in self.nodes:
                self.nodes.discard(id(holder))
                for word, container in holder.items():
                    yield (*head, word) if word != _BREAK else head, container
            else:
                yield head, holder


class _Counter:
    """What one task counts: a vocabulary, a trie for each language, and which words and pairs are frequent."""

    def __init__(self, shortest: int, longest: int, known: np.ndarray | None, parts: int):
        self.shortest, self.longest, self.known, self.parts = shortest, longest, known, parts
        self.words: Vocabulary = Vocabulary()
        self.tries: dict[str, BurstTrie] = {}

    def _is_known(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - (FILTER_BITS.bit_length() - 1))
        return (self.known[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    def _starts(self, lang: str, ids: np.ndarray) -> np.ndarray:
        """Whether a frequent word stands at each place (pairs are counted), or a frequent pair (longer phrases)."""
        salt, used = np.uint64(xxhash.xxh3_64_intdigest(lang.encode())), np.flatnonzero(np.bincount(ids))
        hashes, good = np.zeros(len(self.words.words), dtype=np.uint64), np.zeros(len(self.words.words), dtype=bool)
        hashes[used] = [self.words.hashes[w] for w in used.tolist()]
        good[used] = self._is_known(_word_hash(hashes[used], salt))
        good[_BREAK] = False
        start = good[ids]
        if self.shortest > 2:
            start = start.copy()
            start[-1:] = False
            at = np.flatnonzero(start[:-1] & start[1:])
            start[:] = False
            start[at] = self._is_known(_pair_hash(hashes[ids[at]], hashes[ids[at + 1]], salt))
        return start

    def ids(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.words.__getitem__, tokens), np.int32, len(tokens))

    def add(self, lang: str, ids: np.ndarray) -> None:
        trie = self.tries.setdefault(lang, BurstTrie())
        if self.known is None:  # words alone: one container, which needs no nodes
            n = np.bincount(ids)
            n[_BREAK] = 0
            found = np.flatnonzero(n)
            trie.add(_BREAK, [(w,) for w in found.tolist()], n[found].tolist())
            return
        start = self._starts(lang, ids)
        step = 1 if self.shortest == 2 else 2  # words that a start covers by itself
        for k in range(self.shortest, self.longest + 1):
            m = len(ids) - k + 1
            if m <= 0:
                return
            fits = start[:m].copy()
            for j in range(1, k - step + 1):
                fits &= start[j : m + j]
            at = np.flatnonzero(fits)
            if not len(at):
                return
            self._count(trie, ids, at, k)

    def _count(self, trie: BurstTrie, ids: np.ndarray, at: np.ndarray, k: int) -> None:
        code, v = ids[at].astype(np.int64), len(self.words.words)
        for j in range(1, k - 1):  # a dense number for each different phrase so far
            code = np.unique(code * v + ids[at + j], return_inverse=True)[1]
        code = code * v + ids[at + k - 1]
        _, where, n = np.unique(code, return_index=True, return_counts=True)
        rows = ids[at[where][:, None] + np.arange(k)]
        order = np.argsort(rows[:, 0], kind="stable")
        rows, n = rows[order], n[order]
        begins = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
        rests, counts = list(map(tuple, rows[:, 1:].tolist())), n.tolist()
        for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), len(rows)]):
            trie.add(int(rows[begin, 0]), rests[begin:end], counts[begin:end])

    def runs(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        """What has to leave the tries now; at the ``last`` call everything."""
        entries, renew = sum(t.entries for t in self.tries.values()), len(self.words.words) > MAX_WORDS
        if not (last or renew or entries > MAX_ENTRIES):
            return
        share = 0 if last or renew else 0.5
        for lang, trie in self.tries.items():
            by_length: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
            for head, container in trie.spill(int(trie.entries * share)):
                if self.shortest == self.longest:
                    own = by_length[self.longest]
                    own[0].extend([head + rest for rest in container])
                    own[1].extend(container.values())
                    continue
                for rest, n in container.items():
                    own = by_length[len(head) + len(rest)]
                    own[0].append(head + rest)
                    own[1].append(n)
            for phrases, counts in by_length.values():
                yield self._sorted_runs(lang, np.array(phrases, dtype=np.int64), np.array(counts, dtype="<i8"))
        if renew:
            self.words = Vocabulary()

    def _sorted_runs(self, lang: str, ids: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        """A compressed run for each prefix partition: its phrases in order of their word ids, and their counts."""
        used, place = np.unique(ids[:, :2], return_inverse=True)
        hashes = np.array([self.words.hashes[w] for w in used.tolist()], dtype=np.uint64)[place.reshape(ids[:, :2].shape)]
        with np.errstate(over="ignore"):
            prefix = mixed(hashes[:, 0] * np.uint64(0x9E3779B97F4A7C15) + hashes[:, -1])
        part = (prefix % np.uint64(self.parts)).astype(np.int64)
        order = np.lexsort((*ids.T[::-1], part))
        ids, counts, part = ids[order], counts[order], part[order]
        begins = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        words, rows = self.words.words, ids.tolist()
        texts = [b" ".join([words[w] for w in row]) for row in rows]
        runs, sizes = [], []
        for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), len(texts)]):
            run = counts[begin:end].tobytes() + b"\n".join(texts[begin:end])
            sizes.append(len(run))
            runs.append(pa.compress(run, codec="zstd", asbytes=True))
        n = len(begins)
        columns = [pa.array([lang] * n), pa.array(part[begins], pa.int32()), pa.array([ids.shape[1]] * n, pa.int32()), pa.array(np.diff(np.append(begins, len(texts))), pa.int64()), pa.array(sizes, pa.int64()), pa.array(runs, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "part", "n_words", "phrases", "size", "run"])


def _word_hash(hashes: np.ndarray, salt: np.uint64) -> np.ndarray:
    return mixed(hashes ^ salt)


def _pair_hash(first: np.ndarray, second: np.ndarray, salt: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(mixed(first + salt) * np.uint64(0x9E3779B97F4A7C15) + second)


def _merged(batches, min_count: int) -> Iterator[pa.RecordBatch]:
    """Sums the runs of each (language, prefix partition), which come one after another: (lang, n_words, phrase, n).

    Phrases that are frequent get a row, and all others of a group one together, without a phrase.
    """
    group, sums = None, Counter()

    def rows() -> pa.RecordBatch:
        kept = [(phrase, n) for phrase, n in sums.items() if n >= min_count]
        rest = sum(sums.values()) - sum(n for _, n in kept)
        texts = pa.array([None, *(p for p, _ in kept)], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array([group[0]] * len(texts)), pa.array([group[2]] * len(texts), pa.int32()), texts, pa.array([rest, *(n for _, n in kept)], pa.int64())], names=["lang", "n_words", "phrase", "n"])

    for batch in batches:
        for lang, part, n_words, phrases, size, run in zip(*(c.to_pylist() for c in batch.columns)):
            if group != (lang, part, n_words):
                if group:
                    yield rows()
                group, sums = (lang, part, n_words), Counter()
            plain = pa.decompress(run, decompressed_size=size, codec="zstd", asbytes=True)
            for phrase, n in zip(plain[8 * phrases :].split(b"\n"), np.frombuffer(plain, "<i8", phrases).tolist()):
                sums[phrase] += n
    if group:
        yield rows()


def _counted(docs: DataFrame, shortest: int, longest: int, min_count: int, known=None, parts: int = LEAST_PARTS) -> DataFrame:
    """(lang, n_words, phrase, n): frequent phrases of so many words, and with a null phrase how often all others occur."""

    def count(batches):
        counter = _Counter(shortest, longest, None if known is None else known.value, parts)
        held: dict[str, list[np.ndarray]] = defaultdict(list)

        def flushed():
            for lang, parts in held.items():
                counter.add(lang, np.concatenate(parts))
            held.clear()  # before word ids may change
            yield from counter.runs()

        n = 0
        for batch, texts in text_batches(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), texts):
                tokens: list[bytes] = []
                for words in pieces(text):
                    tokens += words
                    tokens.append(b"")
                if tokens:
                    held[lang].append(counter.ids(tokens))
                n += len(tokens)
                if n >= WORDS_AT_ONCE:
                    yield from flushed()
                    n = 0
        yield from flushed()
        yield from counter.runs(last=True)

    picked = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    runs = picked.mapInArrow(count, "lang string, part int, n_words int, phrases long, size long, run binary")
    dealt = runs.repartition("lang", "part", "n_words").sortWithinPartitions("lang", "part", "n_words")
    return dealt.mapInArrow(lambda batches: _merged(batches, min_count), _COUNTS)


def _filter(frequent: DataFrame):
    """A broadcast bit array that has the bit of every frequent word and pair.  Its size doesn't depend on their number."""

    def bits(batches):
        for batch in batches:
            out = []
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()):
                salt, own = np.uint64(xxhash.xxh3_64_intdigest(lang.encode())), [np.array([xxhash.xxh3_64_intdigest(w)], dtype=np.uint64) for w in phrase.encode().split(b" ")]
                out.append(int((_word_hash(own[0], salt) if len(own) == 1 else _pair_hash(own[0], own[1], salt))[0]) >> 64 - (FILTER_BITS.bit_length() - 1))
            at = np.array(out, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["word", "bits"])

    words = frequent.where("n_words <= 2").select("lang", "phrase").mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    array = np.zeros(FILTER_BITS // 64, dtype="<i8")
    array[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return frequent.sparkSession.sparkContext.broadcast(array.view(np.uint8))


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, n_words, phrase, n) of all phrases of up to ``longest`` words that frequent, and (lang, n) of all words."""
    words = stage(_counted(docs, 1, 1, min_count), "words")
    totals = stage(words.groupBy("lang").agg(F.sum("n").alias("n")).where("n > 0"), "totals")
    n_words = totals.agg(F.sum("n")).first()[0] or 0
    parts = min(MOST_PARTS, max(LEAST_PARTS, n_words // WORDS_PER_PART))
    found = words.where("phrase IS NOT NULL")
    for shortest, last in ((2, min(2, longest)), (3, longest)):
        if shortest <= last:
            known = _filter(found)
            found = found.unionByName(stage(_counted(docs, shortest, last, min_count, known, parts), "frequent").where("phrase IS NOT NULL"))
            known.unpersist()
    return found, totals


def _part(begin, length) -> F.Column:
    return F.array_join(F.slice(F.split("phrase", " "), begin, length), " ")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP, held_share: int = HELD_SHARE) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): the best phrases of each language."""
    frequent, totals = frequent_phrases(docs, min_count, longest)
    candidates = frequent.where("n_words >= 2").withColumnRenamed("n", "a")
    counts = frequent.select("lang", F.col("phrase").alias("part"), F.col("n").alias("times"))
    # cuts: the counts of both parts, in exact decimals
    cuts = candidates.withColumn("k", F.explode(F.expr("sequence(1, n_words - 1)"))).withColumns({"left": _part(F.lit(1), F.col("k")), "right": _part(F.col("k") + 1, F.col("n_words") - F.col("k"))})
    cuts = stage(cuts, "cuts")
    left = counts.select("lang", F.col("part").alias("left"), F.col("times").alias("l"))
    right = counts.select("lang", F.col("part").alias("right"), F.col("times").alias("r"))
    cuts = cuts.hint("merge").join(left, ["lang", "left"]).hint("merge").join(right, ["lang", "right"]).hint("merge").join(totals, "lang")
    lowest = cuts.withColumn("score", F.expr(EXACT_SCORE)).groupBy("lang", "phrase", "n_words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = stage(lowest.select("lang", "phrase", "a", "n", "cut.score", "cut.l", "cut.r"), "scored")
    # what a longer candidate holds
    held = candidates.where("n_words >= 3").select("lang", "phrase", "a", F.explode(F.expr("flatten(transform(sequence(2, n_words - 1), w -> transform(sequence(1, n_words - w + 1), b -> named_struct('b', b, 'w', w))))")).alias("at"))
    held = stage(held.select("lang", "a", _part(F.col("at.b"), F.col("at.w")).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("most")), "held")
    kept = scored.hint("merge").join(held, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most").cast("decimal(20,0)") < held_share * F.col("a").cast("decimal(20,0)")))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
