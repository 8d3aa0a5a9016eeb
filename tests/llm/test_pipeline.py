"""The pipeline's rows against a plain run of its stages on a small table: base rules, near copies, benchmark passages, redaction, pieces."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tracewell.llm import decontamination, packing, pii, quality_rules
from tracewell.llm.words import WordHashes

PATH = public_tokenizers.path("word_bpe_49k.json")


def fixture(seed: int) -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    benchmark = [(k, " ".join(word() for _ in range(30))) for k in range(4)] + [(8, None), (9, "")]
    docs = []
    for i in range(90):
        words = [word() for _ in range(rng.choice([5, 40, 120]))]
        kind = i % 9
        if kind == 1 and docs:
            words = rng.choice([d[1] for d in docs if d[1]]).split()
            words[rng.randrange(len(words))] = word()  # a near copy, or nearly one
        if kind == 2 and docs:
            words = rng.choice([d[1] for d in docs if d[1]]).split()
        if kind == 3:
            words[len(words) // 2 : len(words) // 2] = benchmark[i % 4][1].split()
        if kind == 4:
            words[3:3] = ["mail", "joe@example.org", "or", "+1", "389", "555", "5010"]
        if kind == 5:
            words = words[:10] * 6
        docs.append((i, " ".join(words)))
    docs += [(200, None), (201, ""), (3, " ".join(word() for _ in range(50))), (None, " ".join(word() for _ in range(60))), (None, docs[1][1]), (203, " ".join(word() for _ in range(9_000)))]
    return [*docs, docs[0], docs[0]], benchmark


def plain_run(docs: list[tuple], benchmark: list[tuple]) -> list[tuple]:
    """(doc_id, text) before packing."""
    hashes, kept = WordHashes(), []
    for i, t in docs:
        counts = dict(zip(quality_rules.COUNTS, quality_rules.counts_of((t or "").encode(), hashes)))
        if counts["n_words"] >= 20 and 100 * counts["n_repeat_words"] <= 30 * counts["n_words"]:
            kept.append((i, t))
    stays: list[tuple] = []
    for i, t in sorted(set(kept), key=lambda d: (d[0] is None, d[0] or 0)):
        words = t.lower().split()
        own = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
        if not any(t == u or len(own & other) >= 0.8 * len(own | other) for _, u, other in stays):
            stays.append((i, t, own))

    def bag(words: list) -> Counter:
        return Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))

    def leaks(text: str) -> bool:
        words = [w.decode() for w in decontamination.normal_words(text.encode())]
        for _, item in benchmark:
            own = [w.decode() for w in decontamination.normal_words((item or "").encode())]
            width, b = min(len(own), len(words)), bag(own)
            known = set(b)
            if not own or sum(tuple(words[k : k + 5]) in known for k in range(len(words))) < 0.8 * sum(b.values()):
                continue
            for start in range(len(words) - width + 1):
                a = bag(words[start : start + width])
                common = sum((a & b).values())
                if common >= 0.8 * (sum(a.values()) + sum(b.values()) - common):
                    return True
        return False

    clean = [(i, t) for i, t, _ in stays if not leaks(t)]
    return [(i, re.sub(r"\+1 389 555 5010", "<PHONE>", t.replace("joe@example.org", "<EMAIL>"))) for i, t in clean]


def test_pipeline_against_a_plain_run(spark, tmp_path):
    docs, benchmark = fixture(5)
    columns = "doc_id long, text string, lang string, source string, n_chars long, kept string, fp int"
    spark.createDataFrame([(i, t, None, "s", len(t) if t else None, "yes", 1) for i, t in docs], columns).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = plain_run(docs, benchmark)
    assert 30 < len(left) < len(docs) - 20 and any("<EMAIL>" in t for _, t in left) and None in {i for i, _ in left}
    tokenizer, want = Tokenizer.from_file(PATH), Counter()
    for i, t in left:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], dtype="<u4")
        for piece, start in enumerate(range(0, len(ids), packing.CAPACITY)):
            part = ids[start : start + packing.CAPACITY]
            want[(i, piece, start, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    filled: Counter = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled[r.sequence_id]
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= packing.CAPACITY and len(filled) == packing.lower_bound(dict(Counter(r.length for r in rows)), packing.CAPACITY)


def test_stages_keep_columns_and_judge_every_row(spark):
    docs, _ = fixture(6)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n int, first string")
    for step in (corpus_pipeline.near_dedup, corpus_pipeline.redact):
        if step is corpus_pipeline.redact:
            df = df.withColumn("n_chars", df.n.cast("long"))
        assert step(spark, df, "").columns == df.columns
    assert pii.redacted(df).count() == len(docs)
