"""Page differencing against a brute-force extraction, and what marks correct."""

from __future__ import annotations

import random
import time

import pytest

from tracewell.llm import html_text
from tracewell.llm.html_text import GOES, STAYS, UNLESS_SHARED, page_lines


def length(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table


def brute_shared(a, b):
    """Places of a longest common subsequence, read off the whole table from its end (ties: a line of ``a`` is left first, latest place)."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    table, out, j = length(x, y), [], len(y)
    for i in range(len(x), 0, -1):
        if table[i][j] > table[i - 1][j]:
            j = max(k for k in range(j) if y[k] == x[i - 1])
            out.append(head + i - 1)
    return {*range(head), *out, *range(len(a) - tail, len(a))}


def brute_extract(pages: list[tuple]) -> list[tuple]:
    """(page_id, text) by a plain loop over hosts."""
    def place(url):
        rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        return rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]

    parsed = [(page_id, *place(url), *page_lines(html or "")) for page_id, url, html in pages]
    hosts: dict = {}
    for _, host, path, lines, _ in parsed:
        if host:
            known = hosts.setdefault(host, {})
            known[tuple(lines)] = min(path, known.get(tuple(lines), path))
    shared: dict = {}
    for host, known in hosts.items():
        order = sorted((path.encode(), lines) for lines, path in known.items())
        assert len({p for p, _ in order}) == len(order)  # no ties in these tests
        for at, (path, lines) in enumerate(order):
            sides = []
            for other_path, other in [*order[max(0, at - 1) : at], *order[at + 1 : at + 2]]:
                found = brute_shared(list(lines), list(other))
                if len(found) < len(lines):
                    sides.append((html_text.nearness(path.decode(), other_path.decode()), found))
            nearest = max((n for n, _ in sides), default=0)
            shared[host, lines] = set.intersection(*[f for n, f in sides if n == nearest]) if sides else set()
    return [
        (page_id, "\n\n".join(x for i, x in enumerate(lines) if says[i] == STAYS or (says[i] == UNLESS_SHARED and i not in shared.get((host, tuple(lines)), ()))))
        for page_id, host, _, lines, says in parsed
    ]


def corpus(seed: int, n: int = 160) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        host = rng.choice(["big.example.com"] * 3 + ["a.example.com", "b.example.com", "solo.example.org"])
        menu = "".join(f"<li><a href=/{host}/{k}>{host} {k}</a></li>" for k in range(4))
        body = "".join(f"<p>{rng.choice(['one', 'two', 'three', 'four'])} {rng.randrange(6)}</p>" for _ in range(rng.randint(0, 6)))
        kind = i % 4
        if kind == 0:
            html = f"<body><div>{host}</div><ul>{menu}</ul>{body}<div>All rights</div>"
        elif kind == 1:
            html = f"<body><div>{host}</div><ul>{menu}</ul><article><h1>Title {i % 7}</h1>{body}<ul>{menu}</ul></article><div class=ad>buy {i}</div>"
        elif kind == 2:
            html = f"<body><div>{host}</div>{body}<p>own {i}</p><footer>f</footer>"
        else:
            html = f"<body><div>{host}</div><p>same for many</p>{menu}</body>"
        out.append((i, f"http://{host}/{rng.choice(['x', 'y', 'x/z'])}/{i}?q={i}", html))
    return [*out, (n, None, "<p>no url</p>"), (n + 1, "http://a.example.com/null", None), (n + 2, "mailto:x", "<p>no host</p>"), (0, "http://solo.example.org/again", "<p>again</p>")]


def test_whole_extraction_against_brute_force_for_any_partitions(spark):
    pages = corpus(3)
    want = sorted(brute_extract(pages))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for partitions in (1, 13, 40):
        found = html_text.extract(df.repartition(1 + partitions % 5), partitions)
        assert sorted((r.page_id, r.text) for r in found.collect()) == want
    assert sum(len(t) for _, t in want) < sum(len("\n\n".join(page_lines(h or "")[0])) for _, _, h in pages)


def test_every_page_with_a_neighbour_is_aligned(spark):
    pages = corpus(4)
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = html_text.parsed(html_text.lines_of(df)).withColumnRenamed("lines_digest", "digest").select("host", "path", "digest", "hashes")
    told = html_text.alignments(rows, 7).collect()
    assert len(told) == rows.where("host <> ''").select("digest").distinct().count() > 100  # each different page once, marked or not
    assert sum(any(r.shared) for r in told) > 100


@pytest.mark.parametrize("partitions", [1, 13, 40])
def test_pages_of_one_host_lose_their_menu_at_any_partitions(spark, partitions):
    pages = [(i, f"http://h/a/{i:03}", f"<div>Site menu</div><p>story number {i}</p><div>All rights</div>") for i in range(40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert sorted((r.page_id, r.text) for r in html_text.extract(df, partitions).collect()) == [(i, f"story number {i}") for i in range(40)]


def says(html: str) -> dict[str, int]:
    return dict(zip(*page_lines(html)))


def test_nothing_of_the_article_is_dropped():
    told = says(
        '<div>before</div><article><div class="entry-header"><h1>Title</h1></div><p>so <math><mi>E</mi>=mc</math> and press <button>Start</button> now</p>'
        '<section id="related-work"><p>earlier work</p></section><div class="search-results"><p>results</p></div><h2><a href=x>Linked heading</a></h2>'
        '<ul><li><a href=1>next</a></li></ul><div class="share">share me</div><article><p>a comment</p></article></article><aside>side</aside>'
    )
    assert told == {
        "before": GOES, "Title": STAYS, "so E=mc and press Start now": STAYS, "earlier work": STAYS, "results": STAYS, "Linked heading": STAYS,
        "next": UNLESS_SHARED, "share me": GOES, "a comment": GOES, "side": GOES,
    }


def test_boilerplate_by_whole_names():
    told = says('<div class="cookie-banner">c</div><div class="site-header">h</div><div id="comments">r</div><div class="adrift">kept</div><p class="navigate-sea">sea</p><span class="ad">buy <span>now</span></span><p style="display:none">x</p><p>p')
    assert told == {"c": GOES, "h": GOES, "r": GOES, "kept": UNLESS_SHARED, "sea": UNLESS_SHARED, "buy now": GOES, "x": GOES, "p": UNLESS_SHARED}


def test_long_and_nested_pages_are_linear():
    for html in ("<b>" * 130_000 + "</i>" * 100_000, "<div>" * 80_000 + "</p>" * 100_000, "<span class=ad>" * 50_000, "<a '" * 200_000):
        began = time.time()
        page_lines(html)
        assert time.time() - began < 4
    rng = random.Random(1)
    a, b = ([rng.choice("ab") for _ in range(8_000)] for _ in range(2))
    began = time.time()
    assert len(html_text.shared_lines(a, b)) > 5_000
    assert time.time() - began < 4
