"""Quality rules, language identification and the quality classifier; and the pipeline."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracewell.llm import language_id, quality_classifier, quality_rules
from tracewell.llm.words import WordHashes

DATA = "/root/testdata/sf0.01"


def test_counts_against_brute_force():
    rng = random.Random(1)
    hashes = WordHashes()
    for case in range(300):
        alphabet = ["a", "B", "é", "#", "|", "1", "!", " ", " ", "\n", "\t", "a b c d e f g h\n", "中"]
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80)))
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen, dups = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dups += line in seen
                seen.add(line)
        windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        cover = {p for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for p in range(k, k + 8)}
        found = dict(zip(quality_rules.COUNTS, quality_rules.counts_of(text.encode(), hashes)))
        assert (found["n_words"], found["word_chars"], found["n_symbols"], found["n_dup_lines"], found["n_repeat_words"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(cover)), repr(text)


def test_rules_find_planted_thresholds():
    rng = np.random.default_rng(2)
    x = rng.random((900, 3))
    bad = (x[:, 0] > 0.8) | ((x[:, 1] < 0.2) & (x[:, 2] > 0.5))
    rules = quality_rules.learn(x, bad, ["p", "q", "r"])
    hit = np.zeros(900, dtype=bool)
    for rule in rules:
        hit |= quality_rules._holds(x, ["p", "q", "r"], rule)
    assert (hit == bad).mean() > 0.97 and (hit & ~bad).mean() < 0.02
    assert quality_rules.learn(x[:0], bad[:0], ["p", "q", "r"]) == []
    assert quality_rules.learn(x, np.zeros(900, dtype=bool), ["p", "q", "r"]) == []


def test_rules_job_edges(spark):
    rules = [[quality_rules.Condition("symbols_per_char", True, 0.1)]]
    good = " ".join(f"word{i}" for i in range(30))
    docs = [(1, good, 9), (2, None, 9), (3, "", 9), (4, good.replace("o", "#"), 9), (None, good, 9), (1, good, 9), (5, "same " * 40, 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_words int")
    found = quality_rules.judged(df, rules).collect()
    assert [r.kept for r in found] == [True, False, False, False, True, True, False]
    assert [r.base_failed for r in found] == [False, True, True, False, False, False, True]
    assert found[3].rule == 1
    labels = spark.createDataFrame([(1, None), (7, 1), (None, 0)], "doc_id long, quality int")
    assert quality_rules.learned_list(df.select("doc_id", "text"), labels) == []
    assert quality_rules.judged(df.limit(0), []).count() == 0


def test_language_model(spark):
    words = {"en": "the of and to in that with for from this", "de": "der die und nicht ein mit auf für von dem", "fr": "le la les des une dans pour que qui avec"}
    rng = random.Random(3)
    text = lambda lang: " ".join(rng.choice(words[lang].split()) for _ in range(25))
    docs = [(i, text(lang), lang) for i, lang in enumerate(["en", "de", "fr"] * 20)]
    extra = [(900, None, "en"), (901, "12 !!", "de"), (None, text("fr"), "fr"), (902, text("en"), None), (0, docs[0][1], "en")]
    df = spark.createDataFrame(docs + extra, "doc_id long, text string, lang string")
    apart = language_id.held_out("doc_id", 3, 1)
    model = language_id.train(df.where(~apart))
    assert model[0] == ["de", "en", "fr"]
    found = language_id.identify(df.withColumn("score", F.lit("x")), model).collect()
    said = {r.doc_id: r.lang_pred for r in found}
    assert all(said[i] == lang for i, _, lang in docs) and said[900] == said[901] == "und" and said[902] == "en"
    assert all(0 <= r.score <= 1 for r in found) and len(found) == len(docs) + 5
    folds = {r.doc_id: r.h for r in df.select("doc_id", apart.alias("h")).collect()}
    assert all(folds[i] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in docs) and folds[None] is False
    empty = language_id.train(df.limit(0))
    assert [r.lang_pred for r in language_id.identify(df.limit(1), empty).collect()] == ["und"]


def brute_language(texts: list, learned: list[tuple]) -> list[tuple]:
    """(language, posterior) by plain counting: naive Bayes over the hashed n-grams of each text, one at a time."""
    def cells(text):
        padded = language_id.prepared(text)
        return [int(language_id.grams(language_id._codes(padded[i : i + n]))[n - 1][0]) for n in (1, 2, 3) for i in range(len(padded) - n + 1)]

    counts = {lang: Counter(c for t, own in learned if own == lang for c in cells(t)) for lang in sorted({own for _, own in learned})}
    share = {lang: sum(own == lang for _, own in learned) / len(learned) for lang in counts}
    out = []
    for text in texts:
        if text is None or not any(c.isalpha() for c in text):
            out.append(("und", 0.0))
            continue
        logs = {
            lang: math.log(share[lang]) + sum(math.log((n[c] + language_id.SMOOTHING) / (sum(n.values()) + language_id.SMOOTHING * language_id.BUCKETS)) for c in cells(text))
            for lang, n in counts.items()
        }
        best = max(logs, key=lambda lang: (logs[lang], [-ord(c) for c in lang]))
        out.append((best, 1 / sum(math.exp(v - logs[best]) for v in logs.values())))
    return out


def test_language_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    alphabets = {"aa": "abcde", "bb": "cdefg", "cc": "efg\u00e9\u00df", "dd": "abefg"}
    text = lambda lang, n: " ".join("".join(rng.choice(alphabets[lang]) for _ in range(rng.randint(1, 6))) for _ in range(n))
    learned = [(i, text(lang, 12), lang) for i, lang in enumerate(["aa", "bb", "cc", "aa", "dd"] * 6)]
    asked = [(100 + i, text(rng.choice(list(alphabets)), rng.randint(1, 4))) for i in range(40)] + [(1, "\u00b2 \u00bd \u2460"), (2, "12 !"), (3, None), (4, ""), (5, "\u4e2d"), (6, "x\u0301"), (None, "abc")]
    want = brute_language([t for _, t in asked], [(t, lang) for _, t, lang in learned])
    model = language_id.train(spark.createDataFrame(learned, "doc_id long, text string, lang string"))
    df = spark.createDataFrame(asked, "doc_id long, text string").coalesce(1)
    for at_once, slices in ((1 << 18, 400), (9, 400), (1 << 18, 2)):
        monkeypatch.setattr(language_id, "_CHARS_AT_ONCE", at_once)
        monkeypatch.setattr(language_id, "LANGUAGES_AT_ONCE", slices)
        found = [(r.lang_pred, r.score) for r in language_id.identify(df, model).collect()]
        assert [f for f, _ in found] == [w for w, _ in want]
        assert [s for _, s in found] == pytest.approx([s for _, s in want], rel=1e-4)
    assert [w for w, _ in want[40:44]] == ["und"] * 4 and all(w != "und" for w, _ in want[44:])


def test_ties_go_to_the_first_language_and_every_language_is_learned(spark):
    rows = [(i, f"{chr(0x4e00 + i)}{chr(0x4e00 + i)}", f"l{i:03}") for i in range(401)] + [(900, "same", "zz"), (901, "same", "yy")]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 403
    found = language_id.identify(spark.createDataFrame(rows[395:], "doc_id long, text string, lang string"), model).collect()
    assert {r.doc_id: r.lang_pred for r in found} == {**{i: f"l{i:03}" for i in range(395, 401)}, 900: "yy", 901: "yy"}


def test_long_texts_are_scored_whole(monkeypatch):
    monkeypatch.setattr(language_id, "_CHARS_AT_ONCE", 7)
    matrix = np.log(np.random.default_rng(0).random((language_id.BUCKETS, 2))).astype(np.float32)
    text = "some words that are longer than seven letters"
    chunked = language_id.score([text], ["a", "b"], matrix)
    monkeypatch.setattr(language_id, "_CHARS_AT_ONCE", 1 << 18)
    whole = language_id.score([text], ["a", "b"], matrix)
    assert chunked[0] == whole[0] and chunked[1][0] == pytest.approx(whole[1][0], rel=1e-6)


def test_quality_classifier(spark):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in "bcdfglmn" for b in ("ar", "en", "ing", "ost")]
    good = lambda: " ".join(rng.choice(words) for _ in range(40))
    junk = lambda: " ".join(rng.choice(words) + rng.choice(["###", "***", "$$$"]) for _ in range(40))
    docs = [(i, good() if i % 3 else junk()) for i in range(240)] + [(900, None), (901, ""), (None, good())]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in docs], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(160)] + [(900, None), (None, 1), (777, 1)], "doc_id long, quality int")
    found = quality_classifier.scored(df, quality_classifier.train(df, labels)).collect()
    assert len(found) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    held = [r for r in found if r.doc_id is not None and 160 <= r.doc_id < 240]
    assert np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in held]) > 0.95
    for few in (labels.limit(0), labels.where("quality = 1")):
        assert {r.score for r in quality_classifier.scored(df, quality_classifier.train(df, few)).collect()} == {0.5 if few.count() == 0 else 1.0}


def test_word_vectors_are_sums_over_neighbours():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 9, n).astype("<u2") for n in (0, 1, 2, 30, 7)]
    index, sums = quality_classifier.index_vectors(), np.zeros((9, quality_classifier.DIMENSIONS))
    for text in texts:
        for i, here in enumerate(text.tolist()):
            for j, there in enumerate(text.tolist()):
                if i != j and abs(i - j) <= quality_classifier.NEIGHBOURS:
                    sums[here] += index[there]
    want = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    found = quality_classifier.word_vectors(texts)
    assert np.allclose(found[:9, : quality_classifier.DIMENSIONS], want, atol=1e-5)
    assert np.allclose(found[:, quality_classifier.DIMENSIONS :], index / 2) and not found[9:, : quality_classifier.DIMENSIONS].any()


def test_scores_are_those_of_a_plain_loop(spark):
    """Every score from the model's numbers alone: tokens by an expression of its own, sums one by one, two layers, temperature."""
    rng = random.Random(6)
    words = ["alpha", "Beta", "GAMMA", "x1y22", "--", "...", "end.", "_", "Straße", "a,b"]
    docs = [(i, " ".join(rng.choice(words[: 5 + 5 * (i % 2)]) for _ in range(rng.randint(1, 30)))) for i in range(60)] + [(100, None), (101, ""), (None, "alpha beta"), (3, "again alpha"), (102, "long word " * 70_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    vectors, network = quality_classifier.train(df, spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int"))
    found = sorted(((r.doc_id, r.score, r.predicted) for r in quality_classifier.scored(df, (vectors, network)).collect()), key=str)
    assert len(found) == len(docs)
    want = []
    for doc_id, text in docs:
        tokens, own = [], (text or "").encode().split()
        for word in own:
            for run in re.findall(r"[^\W\d_]+|\d+|_+|[^\w\s]+", word.decode()):
                if run[0].isalpha():
                    if run[0].isupper():
                        tokens.append("U" if len(run) > 1 and run.isupper() else "c")
                    tokens.append("w" + run.lower())
                else:
                    tokens.append(f"9{min(len(run), 6)}" if run[0].isdigit() else "s" + run[:3])
        x, counts = np.zeros(vectors.shape[1]), Counter(tokens)
        for token, n in counts.items():
            x += n * vectors[zlib.crc32(token.encode()) % quality_classifier.BUCKETS].astype(float)
        x = [*(x / max(1, len(tokens))), len(set(own)) / max(1, len(own)), math.log(1 + len(own))]
        z = [min(8, max(-8, (v - m) / s)) for v, m, s in zip(x, network.mean, network.scale)]
        hidden = [math.tanh(sum(v * w for v, w in zip(z, column)) + b) for column, b in zip(network.w[0].T, network.w[1])]
        logit = (sum(h * w for h, w in zip(hidden, network.w[2][:, 0])) + network.w[3][0]) / network.temperature
        want.append((doc_id, 1 / (1 + math.exp(-min(40, max(-40, logit))))))
    for (a, p), (b, q) in zip(sorted((str(d), p) for d, p, _ in found), sorted((str(d), p) for d, p in want), strict=True):
        assert a == b and abs(p - q) < 1e-5
    assert all(predicted == (score >= 0.7) for _, score, predicted in found)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before, sizes = docs.columns, docs.count(), []
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(step(spark, docs, DATA), "test")
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert before > sizes[0] > sizes[1] > sizes[2] == sizes[3] > before // 3
    benchmark = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    texts = [r.text for r in docs.collect()]
    assert not any(b in t for b in benchmark for t in texts) and len(set(texts)) == len(texts)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.select("doc_id").distinct().count() == sizes[-1]
    from tracewell.llm.simhash import copies

    assert copies(docs).count() == 0


def test_pipeline_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(step(spark, docs, DATA), "empty")
    assert docs.count() == 0
