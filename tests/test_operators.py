"""Operators on small fixtures, with nulls, ties, repeats and empty tables."""

from __future__ import annotations

import datetime
import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewell.functions import scalars as fn
from tracewell.operators import binding, classify, coverage, grid, intake, ledger, sequence, text, tree, versions
from tracewell.sources.html_objects import objects_of


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_identity_and_pool(spark):
    files = spark.createDataFrame([(1, "a.md", "x"), (1, "b.txt", "x"), (2, "c", None)], "material_id int, name string, content string")
    found = intake.content_identity(files)
    assert rows(found, "name", "mime", "size") == [("a.md", "text/markdown", 1), ("b.txt", "text/plain", 1), ("c", "application/octet-stream", None)]
    assert rows(intake.resource_pool(found), "name", "occurrences") == [("a.md", 2), ("c", 1)]


def test_unsafe_paths(spark):
    cases = {"a/b.txt": None, "/a": "absolute", "c:/x": "drive", "a\\b": "backslash", "a/../b": "dot", "a//b": "empty part", "a./b": "trailing dot or space", "x/CON.txt": "reserved name", "": "empty"}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.why for r in df.select("p", intake.unsafe_path(F.col("p")).alias("why")).collect()} == cases


def test_paragraphs(spark):
    df = spark.createDataFrame([(1, "n", "a\n\nb\n \n\nc"), (2, "n", None), (3, "n", "")], "material_id int, name string, text string")
    assert rows(intake.paragraphs(df), "material_id", "object_id", "text", "locator") == [(1, "src-00001", "a", "n/paragraph[1]"), (1, "src-00002", "b", "n/paragraph[2]"), (1, "src-00003", "c", "n/paragraph[3]")]


def test_fences_bind_in_order(spark):
    code = spark.createDataFrame([(1, "py", " x ", 1), (1, "py", "x", 5), (1, "js", "x", 2)], "material_id int, language string, content string, ord int")
    fences = spark.createDataFrame([(1, "py", "x", 0, "first"), (1, "py", "x", 9, "second")], "material_id int, language string, content string, ord int, raw string")
    assert rows(intake.bind_fences(code, fences), "ord", "raw") == [(1, "first"), (2, None), (5, "second")]


def test_srcset_order(spark):
    df = spark.createDataFrame([("s.png 1x, l.png 3x, m.png 2x", ["l.png", "f.png"])], "s string, f array<string>")
    assert df.select(intake.ranked_candidates(F.col("s"), F.col("f")).alias("u")).first().u == ["l.png", "m.png", "s.png", "f.png"]


def test_version_check(spark):
    want = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, sha256 string")
    have = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d")], "id int, sha256 string")
    assert rows(intake.version_check(want, have), "id", "status") == [(1, "existing"), (2, "different_source_version"), (3, "failed"), (4, "downloaded")]


def test_canonical_urls(spark):
    cases = [("HTTP://Ex.com:80/a/?b=2&a=1#f", "http://ex.com/a?b=2&a=1", "http://ex.com/a/?a=1&b=2"), ("https://x.org:443", "https://x.org", "https://x.org"), ("mailto:a@b", "mailto:a@b", "mailto:a@b")]
    df = spark.createDataFrame([(c[0],) for c in cases], "u string")
    found = {r.u: (r.a, r.e) for r in df.select("u", fn.canonical_url(F.col("u")).alias("a"), fn.canonical_url(F.col("u"), True).alias("e")).collect()}
    assert found == {c[0]: c[1:] for c in cases}


def test_safe_targets(spark):
    cases = {"https://a.b/c": True, "http://u:p@h/": False, "javascript:x": False, "mailto:a@b.c": True, "http://a b": False, "//x": False}
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    assert {r.u: r.s for r in df.select("u", fn.safe_target(F.col("u")).alias("s")).collect()} == cases


def test_coverage_rules(spark):
    objects = spark.createDataFrame([(1, "o1", "text", "one"), (1, "o2", "table", "two"), (1, "o3", "heading", "three")], "material_id long, object_id string, kind string, text string")
    duties = spark.createDataFrame([(1, "q1", "o1"), (1, "q2", "o2")], "material_id long, obligation_id string, object_id string")
    blocks = spark.createDataFrame([(1, "b1", "source", "one"), (1, "b2", "odd", " ")], "material_id long, block_id string, kind string, markdown string")
    placed = spark.createDataFrame([(1, "b1", "o1"), (1, "b1", "o9")], "material_id long, block_id string, object_id string")
    covers = spark.createDataFrame([(1, "b1", "q1"), (1, "b1", "q9"), (1, "b2", "q2")], "material_id long, block_id string, obligation_id string")
    codes = lambda df: rows(df, "code", "block_id", "object_id", "obligation_id")
    assert codes(coverage.wrong_shape(blocks, ["source"])) == [("shape", "b2", None, None)]
    assert codes(coverage.empty_blocks(blocks, placed)) == [("empty", "b2", None, None)]
    assert codes(coverage.unknown(placed, objects, ["material_id", "object_id"], "unknown_object")) == [("unknown_object", "b1", "o9", None)]
    assert codes(coverage.unmapped(covers, duties, placed)) == [("unmapped", "b2", "o2", "q2")]
    assert codes(coverage.omitted(duties, covers)) == []
    assert codes(coverage.omitted(duties, covers.where("block_id = 'b1'"))) == [("omission", None, "o2", "q2")]
    assert codes(coverage.unplaced(objects, placed)) == [("protected_object", None, "o2", None)]
    assert codes(coverage.headings_lost(objects, placed, blocks)) == [("heading", None, "o3", None)]
    quotes = spark.createDataFrame([(1, "b1", "o1", "on"), (1, "b1", "o1", "xx"), (1, "b1", "o1", ""), (1, "b1", "o7", "a")], "material_id long, block_id string, object_id string, quote string")
    assert len(codes(coverage.misquoted(quotes, objects))) == 3
    assert coverage.omitted(duties.limit(0), covers).count() == 0


def test_rules_of_release_hold_drafts_and_sort_no_lines(spark):
    """Repeated and null keys count as before, and no line is sorted."""
    placed = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (1, "b", "y"), (None, "a", "x"), (2, None, "x")], "material_id long, object_id string, quote string")
    lines = spark.createDataFrame([(1, "a", "xx"), (1, "a", "z"), (3, "b", "y"), (None, "a", "x")], "material_id long, object_id string, text string")
    keys, got = ["material_id", "object_id"], lambda df: sorted(((r.material_id, r.object_id) for r in df.collect()), key=str)
    few = coverage.unknown(placed, lines, keys, "u", few=True)
    assert got(few) == got(coverage.unknown(placed, lines, keys, "u")) == sorted([(1, "b"), (None, "a"), (2, None)], key=str)
    misquoted = coverage.misquoted(placed, lines)
    assert got(misquoted) == sorted([(1, "a"), (1, "a"), (1, "b"), (None, "a"), (2, None)], key=str)
    omitted = coverage.omitted(lines.withColumnRenamed("object_id", "obligation_id"), placed.withColumnRenamed("object_id", "obligation_id"))
    for df in (few, misquoted, omitted):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_verdicts_and_sets(spark):
    found = spark.createDataFrame([(1, "I1", "FAIL"), (1, "I1", "UNKNOWN"), (1, "I2", "UNKNOWN"), (2, "I1", "PASS")], "material_id long, invariant string, status string")
    which = spark.createDataFrame([("I1",), ("I2",), ("I3",)], "invariant string")
    assert rows(coverage.roll_up(found, which), "material_id", "invariant", "verdict") == [(1, "I1", "FAIL"), (1, "I2", "UNKNOWN"), (1, "I3", "PASS"), (2, "I1", "PASS"), (2, "I2", "PASS"), (2, "I3", "PASS")]
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "x int"), spark.createDataFrame([(2,), (3,)], "x int")
    assert rows(coverage.set_difference(a, b, ["x"]), "x", "side") == [(1, "missing"), (3, "unexpected")]
    facts = spark.createDataFrame([("a", "1"), ("b", "1")], "id string, body string")
    more = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "id string, body string")
    assert rows(coverage.merged_facts(facts, more), "id", "status") == [("a", "kept"), ("b", "conflict"), ("c", "added")]


def test_containment_and_ambiguity(spark):
    schema = "material_id long, id string, x double, y double, width double, height double, ancestry array<string>"
    outer = spark.createDataFrame([(1, "big", 0.0, 0.0, 100.0, 100.0, []), (1, "mid", 10.0, 10.0, 50.0, 50.0, [])], schema)
    inner = spark.createDataFrame([(1, "a", 20.0, 20.0, 5.0, 5.0, ["mid", "big"]), (1, "b", 20.0, 20.0, 5.0, 5.0, []), (1, "c", 80.0, 80.0, 5.0, 5.0, [])], schema)
    assert rows(binding.contained_in(inner, outer), "id", "container", "reason") == [("a", "mid", None), ("b", None, "ambiguous"), ("c", "big", None)]


def test_nearest_block_prefers_following(spark):
    findings = spark.createDataFrame([(1, "f", "s", 5), (1, "g", "none", 5)], "material_id long, finding_id string, source_id string, ord int")
    blocks = spark.createDataFrame([(1, "s", 4, "before"), (1, "s", 6, "after")], "material_id long, source_id string, ord int, block_id string")
    assert rows(binding.nearest_block(findings, blocks), "finding_id", "block_id", "is_note") == [("f", "after", False), ("g", None, True)]


def test_link_map_and_context(spark):
    links = spark.createDataFrame([(1, "/a", "https://h/a"), (1, "/a", "https://h/a"), (1, "/b", "https://h/b"), (1, "/b", "https://h/c"), (1, "/d", "javascript:x")], "material_id long, original string, target string")
    assert rows(binding.link_targets(links), "original", "target") == [("/a", "https://h/a")]
    objects = spark.createDataFrame([(1, 0, "heading", "H", None), (1, 1, "text", "first", None), (1, 2, "text", "second", "p"), (1, 3, "text", "third", None), (1, 4, "link", "x", "p")], "material_id long, ord int, kind string, text string, parent_id string").withColumn("object_id", F.col("ord").cast("string"))
    assert rows(binding.sentence_context(objects), "context", "heading") == [("second", "H")]


def test_streaks_and_ranges(spark):
    faults = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("b", 1, "x"), ("b", 2, None), ("c", 1, "x"), ("c", 2, "y")], "k string, n int, fault string")
    assert rows(sequence.streaks(faults, ["k"], ["n"], "fault"), "k", "streak") == [("a", 2), ("b", 0), ("c", 1)]
    ranges = spark.createDataFrame([("a", 0, 5, 9), ("a", 3, 9, 9), ("b", 0, 4, 9), ("b", 5, 9, 9), ("c", 1, 9, 9)], "k string, start int, end int, n int")
    assert rows(sequence.read_coverage(ranges, ["k"], "n"), "k", "fully_read") == [("a", True), ("b", False), ("c", False)]


def test_bounded_groups_match_a_loop(spark):
    sizes = [3, 9, 1, 1, 20, 4, 6, 10, 1]
    objects = spark.createDataFrame([(1, f"o{i}", i, "x" * n) for i, n in enumerate(sizes)], "material_id long, object_id string, ord long, text string")
    want, group, used = [], 0, 0
    for n in sizes:
        if used and used + n > 10:
            group, used = group + 1, 0
        used += n
        want.append(group)
    assert [r["group"] for r in sequence.bounded_groups(objects, 10).orderBy("object_id").collect()] == want


def test_admission_rejects_without_spending(spark):
    t = datetime.datetime(2024, 1, 1)
    calls = spark.createDataFrame([(1, 1, t, 0.06), (1, 2, t, 0.06), (1, 3, t, 0.04), (1, 1, t, 0.0), (2, 9, t, -1.0)], "scope long, call_id long, ts timestamp, amount double")
    assert rows(ledger.admitted(calls, 0.10, 5), "call_id", "reason") == [(1, "duplicate"), (1, None), (2, "budget"), (3, None), (9, "negative")]


def test_usage_and_costs(spark):
    df = spark.createDataFrame([('{"prompt_tokens": 10, "completion_tokens": 2, "prompt_cache_hit_tokens": 99}',), ('{"input_tokens": -5}',)], "b string")
    found = df.select(ledger.normal_usage(F.parse_json("b")).alias("u")).select("u.*").collect()
    assert tuple(found[0]) == (10, 10, 0, 2, True)
    assert found[1].input is None and not found[1].complete
    calls = spark.createDataFrame([(1, "p", 2.0), (2, "p", 1.5), (3, "p", 0.5)], "call_id int, project string, reserved double")
    done = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1), 0.8), (1, datetime.datetime(2024, 1, 2), 9.0), (2, datetime.datetime(2024, 1, 1), None)], "call_id int, ts timestamp, actual double")
    assert rows(ledger.summary(ledger.settled(calls, done), ["project"]), "known", "reserved", "settled_calls", "unknown_calls") == [(0.8, 2.0, 1, 1)]


def test_tree(spark):
    folders = spark.createDataFrame([("a", None, "A"), ("b", "a", "B"), ("c", "b", "C"), ("d", None, "D"), ("x", "y", "X"), ("y", "x", "Y")], "id string, parent string, name string")
    assert rows(tree.paths(folders), "id", "path") == [("a", "A"), ("b", "A/B"), ("c", "A/B/C"), ("d", "D")]
    roots = spark.createDataFrame([("a",), ("b",), ("d",)], "id string")
    assert rows(tree.pruned_roots(folders, roots), "id") == [("a",), ("d",)]
    moves = spark.createDataFrame([("a", "c"), ("c", "d"), ("b", "gone")], "id string, target string")
    assert rows(tree.checked_moves(folders, moves), "id", "reason") == [("a", "cycle"), ("b", "unknown target"), ("c", None)]
    trash = tree.trashed(folders, roots)
    assert rows(trash, "id", "trash_group") == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d")]
    assert rows(tree.restored(trash, folders, "a"), "id", "parent") == [("a", None), ("b", "a"), ("c", "b")]


def test_patches(spark):
    blocks = spark.createDataFrame([(1, "b1", "old"), (1, "b2", "two")], "material_id long, block_id string, markdown string")
    schema = "patch_id string, material_id long, block_id string, old string, new string"
    good = spark.createDataFrame([("p", 1, "b1", "old", "new"), ("p", 1, "b2", "two", "2")], schema)
    bad = spark.createDataFrame([("q", 1, "b1", "old", "new"), ("q", 1, "b2", "other", "2")], schema)
    assert rows(versions.applied(blocks, good)[0], "block_id", "markdown") == [("b1", "new"), ("b2", "2")]
    new, verdicts = versions.applied(blocks, bad)
    assert rows(new, "block_id", "markdown") == [("b1", "old"), ("b2", "two")]
    assert rows(verdicts, "applied", "fault") == [(False, "stale")]


def test_prerequisites_with_a_cycle(spark):
    needs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "concept string, needs string")
    assert rows(versions.prerequisite_closure(needs), "concept", "needs", "distance")[:3] == [("a", "a", 3), ("a", "b", 1), ("a", "c", 2)]


def test_no_depth_is_too_deep(spark):
    """Chains of 150 levels, and cycles."""
    n = 150
    folders = spark.createDataFrame([(i, i - 1 if i else None, f"n{i}") for i in range(n)] + [(900, 901, "x"), (901, 900, "y")], "id int, parent int, name string")
    found = {r.id: (r.path, r.depth) for r in tree.paths(folders).collect()}
    assert len(found) == n and found[n - 1] == ("/".join(f"n{i}" for i in range(n)), n - 1)
    roots = spark.createDataFrame([(0,), (140,), (900,)], "id int")
    below = sorted((r.root, r.id) for r in tree.descendants(folders, roots).collect())
    assert below == [(0, i) for i in range(n)] + [(140, i) for i in range(140, n)] + [(900, 900), (900, 901)]
    from tracewell.operators.delivery import node_faults

    nodes = folders.selectExpr("'t' AS tree", "id", "parent")
    assert rows(node_faults(nodes), "id", "fault") == [(900, "unreachable"), (901, "unreachable")]
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "concept int, needs int")
    closure = sorted(tuple(r) for r in versions.prerequisite_closure(chain).select("concept", "needs", "distance").collect())
    assert closure == [(i, j, j - i) for i in range(40) for j in range(i + 1, 41)]


def test_global_numbers(spark):
    df = spark.createDataFrame([(i * 7919 % 1000,) for i in range(1000)] + [(None,)], "x int").repartition(5)
    assert sorted((r.place, r.x) for r in sequence.globally_numbered(df, ["x"], "place").collect()) == [(1, None)] + [(i + 2, i) for i in range(1000)]
    assert sequence.globally_numbered(df.limit(0), ["x"], "place").count() == 0


def test_folds_carry_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        sizes = [(m, f"o{i:02}", i, "x" * (1 + (i * m) % 5)) for m in (1, 2, 3) for i in range(20)]
        objects = spark.createDataFrame(sizes, "material_id long, object_id string, ord long, text string")
        want = []
        for m in (1, 2, 3):
            group = used = n = 0
            for _, o, _, t in [s for s in sizes if s[0] == m]:
                if n and (used + len(t) > 7 or n >= 3):
                    group, used, n = group + 1, 0, 0
                used, n = used + len(t), n + 1
                want.append((m, o, group))
        assert sorted(tuple(r) for r in sequence.bounded_groups(objects, 7, 3).collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_grids(spark):
    want = spark.createDataFrame([(1, [["row", "yes", "no"], ["r2", "a", "b"]])], "table_id int, grid array<array<string>>")
    have = spark.createDataFrame([(1, [["row", "wrong", "no"]])], "table_id int, grid array<array<string>>")
    diff = grid.differences(want, have)
    assert rows(diff, "r", "c", "expected", "current") == [(0, 1, "yes", "wrong"), (1, 0, "r2", None), (1, 1, "a", None), (1, 2, "b", None)]
    assert rows(grid.repaired(have, diff.where("r = 0")), "markdown") == [("| row | yes | no |",)]
    assert ("row", 1, "yes", "wrong", None) in rows(grid.keyed_differences(want, have), "key", "c", "expected", "current", "state")


def test_protected_lines(spark):
    blocks = spark.createDataFrame([(1, "b", "a\n```\nx\n```\n> q\n# h\n    code\n| t |\nend")], "material_id long, block_id string, markdown string")
    found = text.protected_lines(blocks).orderBy("line_no").collect()
    assert [r.protected for r in found] == [False, True, True, True, True, True, True, True, False]


def test_fences_hold_shorter_fences():
    found = text.protected_mask("p\n````\n```\ncode\n````\nafter\n~~~ x\n~~~ y\n~~~~ \n$$\nm\n$$\nend\n```")
    assert found == [False, True, True, True, True, False, True, True, True, True, True, True, False, True]
    assert text.protected_mask("") == [False]


def test_tightened_text(spark):
    df = spark.createDataFrame([("- a\n\n- b\n\n\n\nx  ",)], "t string")
    assert df.select(text.tightened(F.col("t"))).first()[0] == "- a\n- b\n\nx"


def test_repeated_texts_round_trip(spark):
    long = "y" * 120
    df = spark.createDataFrame([(1, long), (2, long), (3, "short"), (4, None)], "id int, text string")
    words = text.repeated_texts(df)
    short = text.referenced(df, words)
    assert short.where("ref is not null").count() == 2
    assert rows(text.restored(short, words), "id", "text") == rows(df, "id", "text")


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .!\n。", max_size=4000))
def test_spans_cover_exactly(source):
    spans = list(text.cut_spans(source))
    assert "".join(source[a:b] for a, b in spans) == source
    assert all(b - a <= text.SPAN_LIMIT for a, b in spans)


def test_merged_spans(spark):
    df = spark.createDataFrame([("k", 0, 5), ("k", 3, 4), ("k", 5, 9), ("k", 20, 30)], "k string, start int, end int")
    assert rows(text.merged_spans(df, ["k"]), "start", "end") == [(0, 9), (20, 30)]


def test_headings_are_numbered(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 2), (1, 4, 1), (1, 5, 2)], "material_id int, ord int, level int")
    assert [r.number for r in text.numbered_headings(df, ["ord"], 2).orderBy("ord").collect()] == ["1", "1.1", "1.2", "2", "2.1"]


def test_html_objects():
    found = objects_of('<body><nav><a href="/x">Home</a></nav><article><h1>T</h1><p>a &amp; <b>b</b><p>c<img src="i.png" alt="A"></article><script>s()</script>')
    assert [(k, t, g, s) for _, k, t, g, _, _, s in found] == [("link", "Home", "/x", "site_chrome"), ("heading", "T", None, "article"), ("text", "a & b", None, "article"), ("image", "A", "i.png", "article"), ("text", "c", None, "article"), ("unknown", "s()", None, "page")]
    assert objects_of("") == []


def test_classification(spark):
    df = spark.createDataFrame([("image", "", "page"), ("image", "", "article"), ("link", " ", "page"), ("text", "", "page")], "kind string, text string, scope string")
    assert [r[0] for r in df.select(classify.is_decorative(F.col("kind"), F.col("text"), F.col("scope"))).collect()] == [True, False, True, False]


def test_digest_is_ordered(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "material_id int, ord int, t string")
    assert intake.ordered_digest(df, F.col("t"), F.col("ord")).first().digest == hashlib.sha256(b"a\nb").hexdigest()


def test_markdown_objects():
    from tracewell.sources.markup import markdown_objects, rst_directives

    source = "---\na: 1\n---\n# T #\ntext $x$\nmore\n\n- item\n```py\n# no\n```\n| a | b |\n|---|---|\n[^1]: note\nend"
    assert [(k, t, g) for k, t, g, _ in markdown_objects(source)] == [
        ("metadata", "a: 1", "yaml"), ("heading", "T", None), ("text", "text $x$\nmore", None), ("formula", "x", None), ("text", "item", None), ("code", "# no", "py"),
        ("table", "| a | b |\n|---|---|", None), ("footnote", "[^1]: note", None), ("text", "end", None),
    ]
    assert list(markdown_objects("")) == []
    rst = "x\n.. note:: Take care\n   of it\n\n.. toctree::\n   :maxdepth: 2\nend"
    assert [(k, t, n) for k, t, n, _ in rst_directives(rst)] == [("text", "Take care\nof it", "note"), ("metadata", ":maxdepth: 2", "toctree")]


def test_delivery_states(spark):
    from tracewell.operators.delivery import delivery_states

    steps = [("a", k) for k in ("review_ready", "accept", "publish")] + [("b", k) for k in ("publish", "review_ready", "edit", "accept")]
    events = spark.createDataFrame([(p, datetime.datetime(2024, 1, 1), i, k) for i, (p, k) in enumerate(steps)], "project string, ts timestamp, event_id int, kind string")
    assert rows(delivery_states(events), "project", "state", "rejected") == [("a", "published", 0), ("b", "draft", 2)]


def test_marker_issues(spark):
    from tracewell.operators.delivery import issue_counts, marker_issues

    lines = spark.createDataFrame([(1, 0, "{{source:a}}", False), (1, 1, "see {{source:b}}", False), (1, 2, "{{source:a}}", False), (1, 3, "{{source:z}}", True)], "material_id int, line_no int, line string, protected boolean")
    known = spark.createDataFrame([(1, "a")], "material_id int, marker string")
    issues = marker_issues(lines, known)
    assert rows(issues, "line_no", "code") == [(1, "MARKER_PLACEMENT"), (1, "UNKNOWN_MARKER"), (2, "DUPLICATE_RESOURCE")]
    assert rows(issue_counts(issues), "repair", "confirm", "service") == [(2, 1, 0)]


def test_names_and_trees(spark):
    from tracewell.operators.delivery import acronym_definitions, anchored, name_status, node_faults

    names = spark.createDataFrame([(1, "Redis"), (2, "table"), (3, "None"), (4, "first name")], "name_id int, name string")
    quotes = spark.createDataFrame([(1, "uses Redis."), (2, "a <table > tag"), (2, None), (4, "first and last name")], "name_id int, quote string")
    assert rows(name_status(names, quotes), "name_id", "status") == [(1, "verified"), (2, "verified"), (3, "unsearched"), (4, "verified")]
    concepts = spark.createDataFrame([(1, "s", "API"), (2, "s", "AP"), (3, "gone", "X"), (4, "s", "F("), (5, "s", "C++"), (6, "t", "C++")], "concept_id int, source_id string, short string")
    sources = spark.createDataFrame([("s", "an API here, F(x) in C"), ("t", "the C++ way")], "source_id string, text string")
    assert rows(anchored(concepts, sources), "concept_id", "anchored") == [(1, True), (2, False), (3, False), (4, False), (5, False), (6, True)]
    nodes = spark.createDataFrame([("t", 1, None), ("t", 2, 1), ("t", 2, 1), ("t", 3, 9), ("t", 4, 5), ("t", 5, 4)], "tree string, id int, parent int")
    assert rows(node_faults(nodes), "id", "fault") == [(2, "repeated"), (3, "unknown parent"), (4, "unreachable"), (5, "unreachable")]
    line = spark.createDataFrame([("接口（Application Interface, API）",), ("接口（API）",)], "line string")
    assert rows(acronym_definitions(line), "acronym") == [("API",)]


def test_streaming_folds(spark, tmp_path):
    from tracewell.streaming import jobs

    start = datetime.datetime(2024, 1, 1)
    data = [(i, start + datetime.timedelta(seconds=20 * i if i < 5 else 500 + i), i % 2, "error" if i % 3 else "view", 6.0) for i in range(8)]
    log = spark.createDataFrame(data, "event_id long, ts timestamp, user_id long, event_type string, value double")
    log.coalesce(1).write.parquet(str(tmp_path / "log.parquet"))
    events = lambda: jobs.event_stream(spark, str(tmp_path / "log.parquet"))
    admitted = rows(jobs.drained(jobs.admission(events(), 13.0), "t09"), "event_id", "admitted")
    assert admitted == [(0, True), (1, True), (2, True), (3, True), (4, False), (5, False), (6, False), (7, False)]
    assert dict(rows(jobs.drained(jobs.fault_streaks(events()), "t08"), "event_id", "streak"))[7] == 2
    gone = rows(jobs.drained(jobs.expired_leases(events(), 45), "t04"), "user_id")
    assert gone.count((0,)) >= 1 and gone.count((1,)) >= 1


def test_quotes_resolve_to_one_place():
    from tracewell.functions.quotes import resolve

    source = "One two,  three. Four five six. One two."
    assert resolve("three. Four", source) == "three. Four"
    assert resolve("two three", source) == "two,  three"
    assert resolve("One two", source) is None
    assert resolve("Four ... six", source) == "Four five six"
    assert resolve("absent", source) is None and resolve(None, source) is None and resolve("", "") == "" and resolve("x", None) is None


def test_visual_operators_on_odd_input(spark):
    from tracewell.operators import visual
    from tracewell.sources.elements import elements_of

    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<table><tr><td>a<td colspan=2>b</table><pre>x</pre><a href='#q'>l</a>"), (4, "</div><p>open")], "id long, html string")
    same = {r.id: r for r in visual.compared_pages(pages, pages).collect()}
    assert len(same) == 4 and all(all(getattr(r, a) for a in visual.ASPECTS) for r in same.values())
    assert [same[i].local_fragment_targets for i in (1, 2, 3, 4)] == [True, True, False, True]
    assert {r.id: r.is_layout for r in visual.layout_tables(pages).collect()} == {i: False for i in (1, 2, 3, 4)}
    assert visual.compared_pages(pages.limit(0), pages).count() == 0
    assert [r[1] for r in elements_of("<td>a<td>b</td></tr><br/><img src=x>")] == ["", "td", "td", "br", "img"]
    links = spark.createDataFrame([(1, "c1"), (2, "c2"), (3, None), (4, "c4")], "link int, capture_id string")
    boxes = spark.createDataFrame([("c1", "page", "120"), ("c2", "page", "n/a"), ("c4", "frame", "1"), (None, "page", "1")], "capture_id string, scope string, y string")
    assert rows(visual.top_navigation(links, boxes), "link", "y") == [(1, 120.0)]
    facts = spark.createDataFrame([(1, "a"), (1, "z"), (None, "a")], "material_id int, object_id string")
    objects = spark.createDataFrame([(1, "a", "text")], "material_id int, object_id string, text string")
    bound, unknown = visual.bound_quotes(facts, objects)
    assert rows(bound, "quote") == [("text",)] and unknown.count() == 2


def test_reopening_checks_the_state(spark):
    state = "project int, revision int, digest string, version int, frozen boolean, parent string, review string, plan string, accepted boolean"
    projects = spark.createDataFrame([(i, 1, f"d{i}", 3, True, None, "r", "p", True) for i in range(4)], state)
    requests = spark.createDataFrame([(0, 1, "d0", "x"), (1, 2, "d1", "x"), (2, 1, "d2", "x"), (9, 1, "d", "x")], "project int, revision int, digest string, reason string")
    jobs = spark.createDataFrame([(2, "paused"), (2, "uncertain"), (0, "done")], "project int, status string")
    archived, after, refused = versions.reopened(projects, requests, jobs)
    assert rows(archived, "project", "archived_version", "digest", "plan") == [(0, 3, "d0", "p")]
    assert rows(after, "project", "version", "frozen", "parent", "plan")[:2] == [(0, 4, False, "d0", None), (1, 3, True, None, "p")]
    assert rows(refused, "project", "reason") == [(1, "conflict"), (2, "unfinished job"), (9, "unknown project")]


def test_accepted_files_are_new_contents(spark, tmp_path):
    from tracewell.streaming import jobs

    for name, content in (("a", b"1"), ("b", b"1"), ("c", b"2"), ("d", b"33")):
        (tmp_path / f"{name}.bin").write_bytes(content)
    found = jobs.drained(jobs.accepted_files(spark, str(tmp_path), "*.bin"), "accepted")
    assert sorted(r.size for r in found.collect()) == [1, 1, 2] and found.select("sha256").distinct().count() == 3


def test_evidence_operators_on_odd_input(spark):
    from tracewell.operators import evidence

    pairs = spark.createDataFrame([(1, None, None, None, None), (2, "t", "", "404 Not Found", ""), (3, "t", "same words here", "t", "same words here")], "id int, title string, text string, rendered_title string, rendered_text string")
    assert rows(evidence.continuity(pairs), "id", "verdict") == [(1, "accepted"), (2, "error page"), (3, "accepted")]
    terms = spark.createDataFrame([(1, 1, "ab", "X"), (2, 1, "zz", ""), (3, 9, "ab", ""), (4, 1, "", ""), (5, 1, None, None)], "term_id int, id int, term string, short string")
    texts = spark.createDataFrame([(1, "ab " + "." * 300 + "ab X"), (2, None)], "id int, text string")
    found = {r.term_id: (r.status, r.snippet) for r in evidence.term_snippets(terms, texts).collect()}
    assert found[1] == ("found", "." * 80 + "ab X") and {i: s for i, (s, _) in found.items()} == {1: "found", 2: "lookup_failed", 3: "lookup_failed", 4: "lookup_failed", 5: "lookup_failed"}
    accepted = spark.createDataFrame([(1, "缓存", None), (2, "缓存", "Cache"), (3, None, "C++")], "concept int, chinese string, english string")
    new = spark.createDataFrame([(10, " 缓 存", "CACHE", False), (11, "缓存", "Buffer", True), (12, "缓存", "Other", False), (13, None, "c++", False), (14, None, None, None)], "concept int, chinese string, english string, verified boolean")
    assert rows(evidence.coalesced_concepts(new, accepted), "concept", "kind", "of") == [(10, "alias", 2), (11, "completion", 1), (12, "new", None), (13, "alias", 3), (14, "new", None)]
    checks = spark.createDataFrame([(1, c, "preserved") for c in evidence.VISUAL_CATEGORIES] + [(2, "text", "lost"), (3, None, None)], "page int, category string, status string")
    assert rows(evidence.visual_verdicts(checks), "page", "verdict") == [(1, "verified"), (2, "incomplete"), (3, "incomplete")]
    items = spark.createDataFrame([(1, "i"), (2, "j")], "item long, x string").select("item")
    owners = spark.createDataFrame([(1, 7), (1, 8)], "item long, link int")
    assert rows(evidence.without_reference_links(items, owners, spark.createDataFrame([(7,), (8,)], "link int")), "item") == [(2,)]
    assert evidence.known_before(spark.createDataFrame([(1, None, None, None)], "item_id int, url string, sha string, summary string"), spark.createDataFrame([(None, None, None, "created")], "url string, sha string, text string, state string")).count() == 0


def test_drafting_operators_on_odd_input(spark):
    from tracewell.operators import drafting

    texts = spark.createDataFrame([("# Article Metadata\nx",), ("## 出版信息\n# two",), ("Article Metadata",), ("",), (None,)], "t string")
    assert [r[0] for r in texts.select(drafting.info_label(F.col("t"))).collect()] == ["Article Metadata", None, None, None, None]
    current = spark.createDataFrame([(1, "b c"), (2, "b"), (3, "{{m}} b"), (4, None)], "id int, text string")
    earlier = spark.createDataFrame([(1, 1, "b {{m}}c"), (2, 1, "{{m}}\nb"), (2, 2, "b\n{{m}}"), (3, 1, "{{m}}\nb"), (4, 1, None)], "id int, version int, text string")
    markers = spark.createDataFrame([(i, "{{m}}") for i in range(1, 6)], "id int, marker string")
    assert rows(drafting.previous_positions(current, earlier, markers), "id", "version") == [(2, 1)]
    items = spark.createDataFrame([(1, 1, "a", True, False), (2, 1, "a", True, False), (3, 1, "b", True, False), (4, 1, "b", False, True), (5, None, "c", True, False)], "id int, parent int, name_key string, archived boolean, trashed boolean")
    back = spark.createDataFrame([(i, False) for i in (1, 2, 3, 5)], "id int, archive boolean")
    assert rows(drafting.archive_changes(items, back), "id", "archived", "reason") == [(1, True, "collision"), (2, True, "collision"), (3, False, None), (4, False, None), (5, False, None)]
    totals = drafting.campaign_totals(spark.createDataFrame([("a", 1, None)], "campaign string, material int, amount double"), spark.createDataFrame([("b", 2)], "campaign string, calls int"))
    assert rows(totals, "campaign", "calls", "complete", "reconciled") == [("a", 1, False, False), ("b", 0, True, False)]
    units = spark.createDataFrame([(1, "u", "f")], "plan int, unit string, fact string")
    none = units.limit(0).select("plan", "fact")
    after, refused = drafting.covered_plans(units, none, units.limit(0).select("plan", "fact", "unit"))
    assert after.count() == 1 and refused.count() == 0


def test_screening_operators_on_odd_input(spark):
    from tracewell.operators import screening

    df = spark.createDataFrame([("a.a.a", ["a.a", ""]), ("", ["x"]), (None, ["x"]), ("xx", [])], "t string, l array<string>")
    found = [[tuple(s) for s in r[0]] if r[0] is not None else None for r in df.select(screening.literal_spans(F.col("t"), F.col("l"))).collect()]
    assert found[:2] == [[(0, 3)], []] and found[3] == []
    objects = spark.createDataFrame([(1, "site_chrome"), (2, None), (3, "article")], "id int, source_scope string")
    decisions = spark.createDataFrame([(1, True, True), (3, True, None)], "id int, present boolean, explain boolean")
    assert rows(screening.responsibilities(objects, decisions, ["id"]), "id", "present", "explain") == [(1, False, False), (2, False, False), (3, True, False)]
    materials = spark.createDataFrame([(1, True), (2, False), (3, True)], "material int, has_manifest boolean")
    figures = spark.createDataFrame([(1, True, None), (2, False, False)], "material int, ready boolean, bound boolean")
    renders = spark.createDataFrame([(3, True, None, None)], "material int, attempted boolean, completed boolean, gaps int")
    assert rows(screening.complete_materials(materials, figures, renders), "material", "why") == [(1, "open figures"), (2, None), (3, "render not completed")]


# ---------------------------------------------------------------- literals in texts


def held_by_hand(texts, literals):
    return sorted((k, x) for k, t in texts for x in {x for x in literals if x} if t is not None and x in t)


def test_literals_are_found_as_by_a_nested_loop(spark, monkeypatch):
    from tracewell.operators import literals as lit

    monkeypatch.setattr(lit, "SLICE", 3)
    rng = random.Random(2)
    texts = [(i % 17, "".join(rng.choice("abé ") for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(None, "aaaaaaaaaa bé"), (3, None), (4, ""), (5, "x\x00y\\E.z long tail of text")]
    found = [t[1][a : a + rng.randint(1, 14)] for t in texts if t[1] for a in (rng.randrange(len(t[1])),)]
    wanted = [*found, *found[:5], "", None, "not there at all", "x\x00y", "\\E.z long tail", "aaaaaaaa"]
    df = spark.createDataFrame(texts, "k long, text string").repartition(3)
    got = lit.held(df, spark.createDataFrame([(x,) for x in wanted], "literal string"), ["k"])
    assert sorted(((r.k, r.literal) for r in got.collect()), key=str) == sorted(held_by_hand(texts[:-4] + texts[-3:], wanted) + [(None, x) for _, x in held_by_hand([(0, texts[-4][1])], wanted)], key=str)
    assert lit.held(df.limit(0), spark.createDataFrame([("abc",)], "literal string"), ["k"]).count() == 0
    assert lit.held(df, spark.createDataFrame([], "literal string"), ["k"]).count() == 0


def test_words_stand_alone(spark):
    from tracewell.operators import literals as lit

    df = spark.createDataFrame([(1, "a c++ f(x) cat"), (2, "concat cats"), (3, "the longest-word here"), (4, "longest-words")], "k long, text string")
    words = spark.createDataFrame([("c++",), ("f(",), ("cat",), ("longest-word",)], "literal string")
    assert sorted((r.k, r.literal) for r in lit.held_words(df, words, ["k"]).collect()) == [(1, "c++"), (1, "cat"), (3, "longest-word")]


def test_words_of_letters_meet_the_runs_of_a_text(spark, monkeypatch):
    """One pass over the texts and one join, no text again for each word that it may hold; a list too long for a broadcast gives the same."""
    import re

    from tracewell.operators import literals as lit

    monkeypatch.setattr(lit, "held", None)
    rng = random.Random(4)
    texts = [(i % 9, "".join(rng.choice("ab. é\n") for _ in range(rng.randint(0, 30)))) for i in range(80)] + [(None, "ab"), (2, None), (2, ""), (3, "ab ab"), (3, "ab ab"), (4, "\n"), (5, "a b")]
    words = ["a", "b", "ab", "ba", "aab", "", "a", None]
    df = spark.createDataFrame(texts, "k long, text string")
    by_hand = sorted(((k, x) for k, t in texts if t is not None for x in set(words) - {None} if re.search(f"(?<![a-z]){x}(?![a-z])", t)), key=str)
    wanted = spark.createDataFrame([(x,) for x in words], "literal string")
    got = lit.held_words(df, wanted, ["k"])
    assert rows(got, "k", "literal") == by_hand
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # the words' broadcast
    monkeypatch.setattr(lit, "small", lambda df: binding.small(df, 2))
    long = lit.held_words(df, wanted, ["k"])
    assert "Broadcast" not in long._jdf.queryExecution().executedPlan().toString()
    assert rows(long, "k", "literal") == by_hand


def test_many_literals_meet_texts_without_a_nested_loop(spark):
    """More literals than a broadcast list may have, joined by their rare grams."""
    from tracewell.operators import literals as lit

    many = spark.range(binding.BROADCAST_ROWS + 50).selectExpr("concat('literal number ', lpad(id, 9, '0'), ' of many') AS literal")
    texts = spark.range(300).selectExpr("id AS k", "concat('before literal number ', lpad(id * 331, 9, '0'), ' of many after') AS text")
    got = lit.held(texts, many, ["k"])
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    assert sorted(r.k for r in got.collect()) == [k for k in range(300) if k * 331 < binding.BROADCAST_ROWS + 50]


# ---------------------------------------------------------------- plans of units


def live_dependencies(nodes, depends):
    """What each kept node leads to over removed ones, by a plain walk."""
    out = set()
    for node, kept in nodes.items():
        seen, todo = set(), [b for a, b in depends if a == node] if kept else []
        while todo:
            here = todo.pop()
            if here in seen:
                continue
            seen.add(here)
            if nodes.get(here, True):
                out |= {(node, here)} if here != node else set()
            else:
                todo += [b for a, b in depends if a == here]
    return sorted(out, key=str)


def test_dependencies_are_bridged_as_by_a_walk(spark):
    from tracewell.operators import planning

    rng = random.Random(4)
    for case in range(2):
        n = 40
        nodes = {i: rng.random() < 0.4 for i in range(n)}
        depends = [(rng.randrange(n), rng.randrange(n + 1 if case else n)) for _ in range(70)]
        got = planning.bridged(spark.createDataFrame(list(nodes.items()), "node int, kept boolean"), spark.createDataFrame(depends, "node int, needs int"))
        assert rows(got, "node", "needs") == live_dependencies(nodes, depends)


def test_a_chain_of_a_thousand_removed_units(spark):
    from tracewell.operators import planning

    nodes = [(i, i in (0, 1001)) for i in range(1002)]
    got = planning.bridged(spark.createDataFrame(nodes, "node int, kept boolean"), spark.createDataFrame([(i, i + 1) for i in range(1001)], "node int, needs int"))
    assert rows(got, "node", "needs") == [(0, 1001)]
    assert planning.bridged(spark.createDataFrame([], "node int, kept boolean"), spark.createDataFrame([], "node int, needs int")).count() == 0


def test_concepts_follow_their_prerequisites(spark):
    from tracewell.operators import planning

    places = {1: 5, 2: 3, 3: 9, 4: 2, 5: 1, 6: 7, 7: 7, 8: 4, 9: None, 10: 6, 11: 6}
    requires = [(1, 3), (2, 3), (3, 4), (5, 6), (6, 7), (7, 5), (8, 6), (10, 99), (11, 10), (9, 1), (4, 4), (4, 4)]
    order, faults = planning.concept_order(spark.createDataFrame(list(places.items()), "concept int, place int"), spark.createDataFrame(requires, "concept int, needs int"))
    assert rows(order, "concept", "place", "level", "nth") == []  # 4 needs itself, and 3, 2 and 1 need it
    assert sorted(rows(faults, "concept", "reason")) == [
        (1, "needs a fault"), (2, "needs a fault"), (3, "needs a fault"), (4, "cycle"), (5, "cycle"), (6, "cycle"), (7, "cycle"), (8, "needs a fault"), (9, "no place"), (10, "unknown prerequisite"), (11, "needs a fault"),
    ]
    order, faults = planning.concept_order(spark.createDataFrame([(1, 5), (2, 3), (3, 9), (4, 2)], "concept int, place int"), spark.createDataFrame([(1, 3), (2, 3), (3, 4)], "concept int, needs int"))
    assert rows(order, "concept", "place", "level", "nth") == [(1, 5, 2, 4), (2, 3, 2, 3), (3, 3, 1, 2), (4, 2, 0, 1)]
    assert faults.count() == 0


def test_lineages_leave_cycles_out_and_show_orphans(spark):
    folders = spark.createDataFrame([("a", None, "A"), ("b", "a", "B"), ("x", "y", "X"), ("y", "x", "Y"), ("z", "x", "Z"), ("o", "gone", "O"), ("p", "o", "P"), ("s", "s", "S"), *((f"d{i}", f"d{i - 1}" if i else "b", f"{i}") for i in range(20))], "id string, parent string, name string")
    found = {r.id: r.path for r in tree.lineages(folders).collect()}
    assert found == {"a": "A", "b": "A/B", "o": "O", "p": "O/P"} | {f"d{i}": "A/B/" + "/".join(map(str, range(i + 1))) for i in range(20)}


def test_listing_of_ten_thousand_folders(spark):
    """A search over 10,000 folders; the page holds folders first, documents after them."""
    folders = spark.range(10_000).selectExpr("id", "CASE WHEN id > 0 THEN id div 10 END AS parent", "concat('Ordner ', id) AS name", "false AS trashed", "id AS created")
    documents = spark.range(500).selectExpr("100000 + id AS id", "id AS parent", "concat('Maß ', id) AS title", "false AS trashed", "false AS archived", "id AS created")
    found = tree.listed(folders, documents, query="MASS 49", limit=5).collect()
    assert [(r.place, r.total, r.kind, r.title) for r in sorted(found, key=lambda r: r.place)] == [(0, 11, "document", "Maß 49"), *((k + 1, 11, "document", f"Maß {490 + k}") for k in range(4))]


# ---------------------------------------------------------------- nested JSON, rectangles


def test_members_at_any_depth(spark):
    from tracewell.sources import nested

    deep = '{"sha256":"' + "a" * 64 + '"}'
    for _ in range(12):
        deep = '[{"k":' + deep + "}]"
    bodies = spark.createDataFrame([(1, deep), (2, "no json"), (3, None), (4, '{"sha256":"x","a":{"sha256":["' + "b" * 64 + '"],"response_markdown_blob":"' + "c" * 64 + '"}}'), (5, "[]"), (6, "3")], "id int, body string")
    assert rows(nested.blob_references(bodies), "id", "sha") == [(1, "a" * 64), (4, "c" * 64)]
    assert rows(nested.members(bodies.where("id = 4")), "path", "kind") == [("/a", "object"), ("/a/response_markdown_blob", "string"), ("/a/sha256", "list"), ("/a/sha256/0", "string"), ("/sha256", "string")]
    assert nested.search_results(bodies).count() == 0


def test_containers_are_found_as_by_all_pairs(spark):
    rng = random.Random(8)
    rects = [(rng.randrange(2), i, rng.uniform(-50, 50), rng.uniform(-50, 50), rng.choice([0.0, 0.5, 3.0, 20.0, 90.0]) * rng.random(), rng.choice([0.0, 1.0, 8.0, 64.0]) * rng.random(), []) for i in range(150)]
    df = spark.createDataFrame(rects, "material_id int, id long, x double, y double, width double, height double, ancestry array<long>")
    want = []
    for m, i, x, y, w, h, _ in rects:
        holds = [j for n, j, a, b, c, d, _ in rects if n == m and j != i and a <= x and b <= y and a + c >= x + w and b + d >= y + h]
        if holds:
            want.append((m, i, holds[0] if len(holds) == 1 else None, "ambiguous" if len(holds) > 1 else None))
    assert sorted(rows(binding.contained_in(df, df), "material_id", "id", "container", "reason"), key=str) == sorted(want, key=str)


def test_a_hundred_thousand_rectangles_of_one_material(spark):
    inner = spark.range(100_000).selectExpr("1 AS material_id", "id", "CAST(id % 400 * 10 + 2 AS DOUBLE) AS x", "CAST(id div 400 * 10 + 2 AS DOUBLE) AS y", "3D AS width", "3D AS height", "CAST(array() AS ARRAY<BIGINT>) AS ancestry")
    outer = inner.selectExpr("material_id", "id + 1000000 AS id", "x - 1 AS x", "y - 1 AS y", "6D AS width", "6D AS height", "ancestry")
    found = binding.contained_in(inner, outer)
    assert found.where("container = id + 1000000").count() == 100_000 == found.count()


# ---------------------------------------------------------------- edit lists


def test_edits_of_a_patch_exclude_each_other(spark):
    from tracewell.operators import edits

    texts = spark.createDataFrame([(1, "aa bb cc bb"), (2, "x\ny z"), (3, None)], "id int, text string")
    made = [(1, 1, 1, "aa", "A"), (1, 2, 1, "cc b", "C"), (2, 1, 1, "bb", "B"), (3, 1, 1, "aa b", "x"), (3, 2, 1, "a bb c", "y"), (4, 1, 2, "x\ny", "q"), (5, 1, 9, "x", "q"), (6, 1, 2, "z", "z"), (7, 1, 2, "", "z"), (8, 1, 2, "z", ""), (9, 1, 3, "z", "y")]
    found = edits.located(spark.createDataFrame(made, "patch int, nth int, id int, old string, new string"), texts)
    assert rows(found.where("fault IS NOT NULL"), "patch", "nth", "fault") == [(2, 1, "not unique"), (3, 2, "overlap"), (4, 1, "several lines"), (5, 1, "unknown block"), (6, 1, "no change"), (7, 1, "no old text"), (9, 1, "unknown block")]
    patches = spark.createDataFrame([(p, 1, 3, "d") for p in (1, 3, 8, 10)] + [(11, 1, 2, "d"), (12, 2, 3, "d"), (13, 1, 3, "e"), (14, 5, 3, "d")], "patch int, material int, base_revision int, digest string")
    judged = edits.verdicts(found, patches, spark.createDataFrame([(1, 3, 1, "d"), (2, 3, 2, "d")], "material int, revision int, rounds int, digest string"))
    assert rows(judged, "patch", "fault") == [(1, None), (10, "no edits"), (11, "stale"), (12, "too many rounds"), (13, "other text"), (14, "stale"), (3, "overlap"), (8, None)]
    assert rows(edits.applied(found, judged), "patch", "id", "text") == [(1, 1, "A bb Cb"), (8, 2, "x\ny ")]


def test_commits_on_lines_that_are_missing_or_empty(spark):
    from tracewell.operators import edits

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    texts = spark.createDataFrame([(1, "é\n\nlast"), (2, "one")], "id int, text string")
    commits = spark.createDataFrame([(1, 1, sha("é\n\nlast"), sha("E\n\nfirst")), (1, 3, sha("E\n\nfirst"), sha("E\n\nend")), (2, 1, sha("one"), sha("two"))], "id int, round int, before string, after string")
    made = spark.createDataFrame([(1, 1, 1, 3, "last", "first"), (1, 1, 2, 1, "é", "E"), (1, 3, 1, 3, "first", "end"), (2, 1, 1, 2, "one", "two")], "id int, round int, nth int, line int, old string, new string")
    assert rows(edits.replayed(texts, commits, made), "id", "round", "state") == [(1, 1, "verified"), (1, 3, "verified"), (2, 1, "edits don't fit")]
    assert edits.replayed(texts.limit(0), commits.limit(0), made.limit(0)).count() == 0


# ---------------------------------------------------------------- tables with spans


def test_spans_make_a_logical_grid():
    from tracewell.sources.tables import placed_cells, tables_of

    assert placed_cells([[("2", None, "a"), (None, "2", "b")], [(None, None, "c"), ("9", None, "d")], [("0", "x", "e")]]) == [(0, 0, 2, 1, "a"), (0, 1, 1, 2, "b"), (1, 1, 1, 1, "c"), (1, 2, 2, 1, "d"), (2, 0, 1, 1, "e")]
    html = "<table><tr><th rowspan=2>h<td>1<tr><td>2<table><tr><td>in</table></table><table></table><p>t"
    assert tables_of(html) == [(1, 0, 0, 2, 1, True, "h"), (1, 0, 1, 1, 1, False, "1"), (1, 1, 1, 1, 1, False, "2in"), (2, 0, 0, 1, 1, False, "in")]
    assert tables_of("") == [] == tables_of("<td>loose</td>")


def test_columns_match_one_header_only(spark):
    want = spark.createDataFrame([(1, 1, "Size"), (1, 2, "name"), (1, 3, "gone"), (1, 4, "a"), (2, 1, "x")], "table_id int, c int, name string")
    have = spark.createDataFrame([(1, 1, "NAME"), (1, 2, "size (cm)"), (1, 3, "Last name"), (1, 4, "area")], "table_id int, c int, name string")
    assert rows(grid.matched_columns(want, have), "table_id", "want_c", "have_c", "state") == [(1, 1, 2, None), (1, 2, 1, None), (1, 3, None, "missing column"), (1, 4, None, "ambiguous column"), (2, 1, None, "missing column")]


def test_scanners_write_their_rows_in_small_batches(spark, monkeypatch):
    import pyarrow as pa

    from tracewell.operators.text import protected_lines, source_spans
    from tracewell.sources import rows
    from tracewell.sources.elements import elements
    from tracewell.sources.html_objects import page_objects
    from tracewell.sources.markup import rst_directives, scanned
    from tracewell.sources.tables import html_tables

    page = "<p><a href='x'>" + "y" * 40 + "</a></p>" + "<table><tr><td>1</td></tr></table>"
    kinds = [
        (scanned, (rst_directives,), "id long, text string", ".. note:: x\n.. note:: y\n", 2),
        (source_spans, (), "id long, text string", "word " * 400, 3),
        (page_objects, (), "page_id long, html string", page, 3),
        (elements, (), "id long, html string", page, 6),
        (html_tables, (), "id long, html string", page, 1),
        (protected_lines, (), "material_id long, block_id string, markdown string", "a\nb", 2),
    ]
    for operator, more, columns, text, each in kinds:
        table = spark.createDataFrame([], columns)
        made, kept = [], type(table).mapInArrow
        with monkeypatch.context() as patch:
            patch.setattr(type(table), "mapInArrow", lambda self, f, schema: made.append(f) or kept(self, f, schema))
            operator(table, *more)
        id_ = {"material_id": 1, "block_id": "b"} if operator is protected_lines else "1" if operator in (scanned, source_spans) else 1
        ids = pa.array([id_] * 3000)
        names = ["page_id" if "page_id" in columns else "id", "html" if "html" in columns else "text"]
        out = list(made[0](iter([pa.RecordBatch.from_arrays([ids, pa.array([text] * 3000)], names=names)])))
        assert sum(b.num_rows for b in out) == 3000 * each, operator
        assert max(b.num_rows for b in out) <= rows.ROWS_AT_ONCE


def test_rows_leave_within_a_long_text():
    import pyarrow as pa

    from tracewell.sources import rows

    schema = pa.schema({"id": pa.int64(), "text": pa.string()})
    batch = pa.RecordBatch.from_arrays([pa.array([1, None, 2]), pa.array(["x", None, "x"])], names=["id", "text"])
    seen = []

    def scanner(text):
        for n in range(5):
            seen.append(n)
            yield (text * (rows.CHARS_AT_ONCE // 2),)

    out = rows.rows_of(iter([batch]), scanner, schema)
    assert next(out).num_rows == 2 and len(seen) == 2
    rest = list(out)
    assert 2 + sum(b.num_rows for b in rest) == 15
    assert {b.schema for b in rest} == {schema}
    assert list(rows.rows_of(iter([]), scanner, schema)) == []


def test_replayed_chains_write_no_texts_between_rounds(spark):
    from tracewell.operators import edits

    texts = spark.createDataFrame([(1, "a b"), (2, None)], "id long, text string")
    sha = lambda text: __import__("hashlib").sha256(text.encode()).hexdigest()
    commits = spark.createDataFrame([(1, 2, sha("a b"), sha("c b")), (1, 10, sha("c b"), sha("c d")), (2, 1, sha(""), sha(""))], "id long, round int, before string, after string")
    made = spark.createDataFrame([(1, 2, 1, 1, "a", "c"), (1, 10, 1, 1, "b", "d")], "id long, round int, nth int, line int, old string, new string")
    out = edits.replayed(texts, commits, made)
    assert out.inputFiles() == []
    assert sorted(map(tuple, out.collect())) == [(1, 2, "verified"), (1, 10, "verified"), (2, 1, "edits don't fit")]


def test_closure_makes_each_way_of_a_chain_once(spark, monkeypatch):
    from tracewell.operators import versions

    chain = spark.createDataFrame([(n, n + 1) for n in range(16)], "concept long, needs long")
    made, kept = [], type(chain).unionByName
    monkeypatch.setattr(type(chain), "unionByName", lambda self, other: made.append(other.count()) or kept(self, other))
    assert versions.prerequisite_closure(chain).count() == 136
    assert sum(made) == 136 - 16


def test_concepts_meet_one_row_of_each_source(spark):
    from tracewell.operators import planning

    units = spark.createDataFrame([(9, 1), (4, 1), (7, 2), (None, 2), (3, None)], "place long, source long")
    concepts = spark.createDataFrame([(1, None, 1), (2, None, 2), (3, 8, 1), (4, None, 5)], "concept long, planned long, source long")
    placed = planning.placements(units, concepts, spark.createDataFrame([(3, 2)], "concept long, place long"))
    assert sorted(map(tuple, placed.collect())) == [(1, 4, "first source"), (2, 7, "first source"), (3, 2, "first use"), (4, None, "no place")]
    assert "Aggregate [source" in placed._jdf.queryExecution().optimizedPlan().toString()


def test_plans_are_dealt_over_tasks_of_bounded_rows(spark, monkeypatch):
    from tracewell.operators import drafting
    from tracewell.plans import staging

    monkeypatch.setattr(staging, "TASK_ROWS", 3)
    units = spark.createDataFrame([(p, f"u{k}", f"f{k}") for p in range(9) for k in range(3)], "plan long, unit string, fact string")
    missing = spark.createDataFrame([(p, "m") for p in range(9)] + [(None, "m")], "plan long, fact string")
    assigned = spark.createDataFrame([(p, f, u) for p in range(9) for f, u in [("m", "u0")] * (1 + (p == 1)) + [("n", "u1")] * (p == 2) if p != 3] + [(4, "m", None), (None, "m", "u0")], "plan long, fact string, unit string")
    after, refused = drafting.covered_plans(units, missing, assigned)
    assert refused.rdd.getNumPartitions() == staging.task_count(units) == 9
    assert {r.plan: r.reason for r in refused.collect()} == {1: "assigned twice", 2: "fact not missing", 3: "fact not assigned", 4: "assigned twice", None: "fact not assigned"}
    assert after.where("fact = 'm'").count() == 6  # those of plans 0 and 5 to 8, and the one without a plan
