"""Main text of web pages by nearest-URL page differencing.

Every page is parsed into lines (the text of its block elements).  Pages of a host are ordered by
URL path, each is paired with its nearest different neighbour there, and their lines are aligned by
longest common subsequence.  Shared lines come from the site's template and are deleted.  Nearness
is the number of leading path segments in common; if both neighbours are equally near, a line must
be shared with both, so that one near copy next door deletes no article.

Marks in the page correct what the alignment decides, line by line:

* inside a marked article (``article``, or else ``main`` or a container named as one) a shared line stays, as
  two articles may share a paragraph, unless it holds nothing but links and is no heading; what lies outside the
  article that a page marks goes;
* lines of navigation, footers, asides, forms, adverts, notices and comments go even if no neighbour has
  them: by element, role, or whole class and id names ("related-work" is none of them), or as an
  article nested in an article that has begun;
* a page all of whose lines are shared with one neighbour isn't all template: that neighbour tells nothing.

How it scales.  Parsing is one pass over pages; tags are matched in linear time.  Pages with equal lines
on a host are one row for the alignment, of which only hashes travel.  Those rows are dealt by range of
(host, path), so a host with a third of all pages spreads over many tasks; a task streams its rows and
holds three pages.  The first and last two pages of each task go through one small second pass, where
they meet their neighbours in other tasks: the result does not depend on the number of partitions.
Alignments return to the pages by a salted digest, so many copies of one page make no hot task.

Edge cases: null html is empty; pages with a null or hostless URL have no neighbour; a page with nothing
left has an empty text; rows that repeat a page_id each get their own row; an empty table gives no rows; other
columns of the input are ignored.  A page is held whole by a task; alignment memory grows with
lines x square root of lines.
"""

from __future__ import annotations

import hashlib
import html
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.url_filter import parsed
from tracewell.plans.staging import stage

#: Tasks that the pages of one equal content return to.
SALTS = 16

# Element names by their role.
SKIPPED = frozenset("script style head template noscript iframe svg object canvas audio video select option datalist textarea annotation".split())
BOILERPLATE = frozenset("nav footer aside form dialog menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RAW = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in ("script", "style", "textarea", "title")}
#: Elements whose start closes an open element of the same kind.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
# Words of class and id names.  A name is boilerplate if it has a word of the first list and no word outside the first two.
NAMED_BAD = frozenset(
    "ad ads advert adverts advertisement advertising adsense breadcrumb breadcrumbs comment comments commentlist respond replies cookie cookies consent "
    "gdpr disclaimer dropdown footer login menu modal nav navbar navigation newsletter notice notices notification notifications pager pagination popup promo "
    "promotion recommended related search share sharing sidebar signup skip social sponsor sponsored sponsors subscribe toolbar topbar widget widgets".split()
)
NAMED_NEUTRAL = frozenset(
    "site page top main bottom left right primary secondary global list links link bar box wrap wrapper container area section block item items inner "
    "outer content post posts article articles entry reader user banner header form thread slot unit text fixed sticky mobile".split()
)
NAMED_TOP = frozenset("header masthead banner".split())
NAMED_SITE = frozenset("site page top main global fixed sticky wrap wrapper container bar inner".split())
NAMED_ARTICLE = frozenset("article article-body article-content articlebody post-content post-body entry-content story story-body hentry".split())
NAMED_MAIN = frozenset("main main-content maincontent content".split())
BAD_ROLES = frozenset("navigation complementary contentinfo search dialog alert alertdialog menu menubar toolbar form".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|</?[a-zA-Z][^>]*>?|[^<]+|<", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PARTS = re.compile(r"[a-z]+")

#: What marks say of a line: it goes, it stays, or it stays unless a neighbour shares it.
GOES, STAYS, UNLESS_SHARED = 0, 1, 2


# ---------------------------------------------------------------- parsing


def _attributes(tag: str, start: int) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(tag, start)}


def name_mark(names: str, inside: bool) -> str | None:
    """What whole class and id names say: 'bad', 'article', 'main' or None; ``inside`` an article, its header is no site header."""
    found = None
    for name in names.lower().split():
        parts = _PARTS.findall(name)
        words = set(parts)
        if words & NAMED_BAD and words <= NAMED_BAD | NAMED_NEUTRAL:
            return "bad"
        if not inside and words & NAMED_TOP and words <= NAMED_TOP | NAMED_SITE:
            return "bad"
        if name in NAMED_ARTICLE:
            found = "article"
        elif name in NAMED_MAIN:
            found = found or "main"
    return found


def _mark(name: str, tag: str, at: int, inside: bool, nested: bool) -> str | None:
    """'skip', 'bad', 'article', 'main' or None for an element that starts."""
    if name in SKIPPED:
        return "skip"
    if name in BOILERPLATE or (name == "header" and not inside):
        return "bad"
    own = "bad" if name == "article" and nested else name if name in ("article", "main") else None
    if at >= len(tag) - 2 or own == "bad":
        return own
    attributes = _attributes(tag, at)
    role = attributes.get("role", "").lower()
    if role in BAD_ROLES or (role == "banner" and not inside) or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return "bad"
    if "style" in attributes and _HIDDEN.search(attributes["style"]):
        return "bad"
    named = name_mark(f"{attributes.get('class', '')} {attributes.get('id', '')}", inside) if name not in ("html", "body") else None
    if named == "bad":
        return "bad"
    return own or ("bad" if role == "article" and nested else role if role in ("article", "main") else named if name in BLOCKS else None)


def page_lines(source: str) -> tuple[list[str], list[int]]:
    """(lines, what marks say of each) of a page, in page order."""
    lines: list[str] = []
    kinds: list[tuple[bool, bool, bool, bool]] = []  # (bad, in article, in main, nothing but links and no heading)
    open_: list[list] = []  # [name, mark, opened again inside]: blocks, and inline elements with a mark
    count: dict[str, int] = {}
    marks = {"skip": 0, "bad": 0, "article": 0, "main": 0}
    held: list[str] = []
    link = words_outside = False
    article_lines = 0

    def flush() -> None:
        nonlocal words_outside, article_lines
        if held:
            line = " ".join("".join(held).split())
            held.clear()
            if line:
                lines.append(line)
                kinds.append((marks["bad"] > 0, marks["article"] > 0, marks["main"] > 0, not words_outside and not any(count.get(h) for h in HEADINGS)))
                article_lines += marks["article"] > 0 and not marks["bad"]
        words_outside = False

    def close() -> None:
        nonlocal article_lines
        name, mark, _ = open_[-1]
        if name in BLOCKS or mark:
            flush()
        open_.pop()
        count[name] -= 1
        if mark:
            marks[mark] -= 1
            if not marks["article"]:
                article_lines = 0

    skip_to = 0
    for match in _TOKEN.finditer(source):
        token = match[0]
        if match.start() < skip_to:
            continue
        if token[0] != "<" or token == "<":
            if not marks["skip"]:
                held.append(html.unescape(token) if "&" in token else token)
                words_outside = words_outside or (not link and not token.isspace())
            continue
        named = _NAME.match(token)
        if not named or token.startswith("<!"):
            continue  # a comment or declaration
        name = named[1].lower()
        if token[1] == "/":
            if name == "a":
                link = False
            if name in BLOCKS or name in SKIPPED:
                if count.get(name):
                    while open_[-1][0] != name:
                        close()
                    close()
                elif name in BLOCKS:
                    flush()
            elif open_ and open_[-1][0] == name:
                open_[-1][2] -= 1
                if open_[-1][2] < 0:
                    close()
            continue
        if name == "br":
            held.append(" ")
            continue
        if name == "a":
            link = True
        block = name in BLOCKS
        if block:
            if count.get("p"):
                while open_[-1][0] != "p":
                    close()
                close()
            while open_ and name in CLOSED_BY.get(open_[-1][0], ()):
                close()
            flush()
        if name in VOID or token.endswith("/>"):
            continue
        inside = marks["article"] > 0 or marks["main"] > 0
        mark = _mark(name, token, named.end(), inside, marks["article"] > 0 and article_lines > 0)
        if block or mark:
            if mark:
                flush()
                marks[mark] += 1
            open_.append([name, mark, 0])
            count[name] = count.get(name, 0) + 1
        elif open_ and open_[-1][0] == name:
            open_[-1][2] += 1
        if name in RAW:  # their content is no markup
            end = RAW[name].search(source, match.end())
            skip_to = end.start() if end else len(source)
    flush()
    level = next((n for n in (1, 2) if any(k[n] and not k[0] for k in kinds)), None)  # an article, or else what main holds
    return lines, [GOES if k[0] or (level and not k[level]) else STAYS if level and not k[3] else UNLESS_SHARED for k in kinds]


def page_blocks(source: str) -> tuple[list[str], list[str]]:
    """(lines of the marked article, lines of a page without one), both without marked boilerplate."""
    lines, says = page_lines(source)
    marked = STAYS in says
    left = [line for line, said in zip(lines, says) if said != GOES]
    return (left, []) if marked else ([], left)


# ---------------------------------------------------------------- alignment


def shared_lines(lines: list, others: list) -> list[int]:
    """Places of ``lines`` in a longest common subsequence with ``others``."""
    # what begins or ends alike needs no table, and lines that only one side has can't be in it
    head = 0
    while head < min(len(lines), len(others)) and lines[head] == others[head]:
        head += 1
    tail = 0
    while tail < min(len(lines), len(others)) - head and lines[-1 - tail] == others[-1 - tail]:
        tail += 1
    left, right = lines[head : len(lines) - tail], others[head : len(others) - tail]
    common = set(left) & set(right)
    at = [head + i for i, x in enumerate(left) if x in common]
    middle = _matched([lines[i] for i in at], [x for x in right if x in common])
    return [*range(head), *(at[i] for i in middle), *range(len(lines) - tail, len(lines))]


def _matched(lines: list, others: list) -> list[int]:
    """Bit-parallel alignment: a row of the length table is one integer, its zero bits are where the length grows.

    Every k-th row is kept and those between are computed again on the way back.
    """
    n, m = len(lines), len(others)
    if not n or not m:
        return []
    places: dict = {}
    for j, x in enumerate(others):
        places.setdefault(x, []).append(j)
    often: dict = {}

    def where(x) -> int:
        if x in often:
            return often[x]
        bits = 0
        for j in places[x]:
            bits |= 1 << j
        if len(places[x]) > 64:
            often[x] = bits
        return bits

    full = (1 << m) - 1
    step = max(1, math.isqrt(n))

    def rows(row: int, begin: int, end: int):
        for i in range(begin, end):
            met = row & where(lines[i])
            row = ((row + met) | (row - met)) & full
            yield row

    kept, row = [full], full
    for i, row in enumerate(rows(full, 0, n), 1):
        if i % step == 0:
            kept.append(row)
    out: list[int] = []
    j, first = m, (n - 1) // step * step
    end = n
    while first >= 0 and j:
        block = [kept[first // step], *rows(kept[first // step], first, end)]
        for i in range(end, first, -1):
            below = (1 << j) - 1
            if (~block[i - first] & below).bit_count() > (~block[i - 1 - first] & below).bit_count():
                j = (where(lines[i - 1]) & below).bit_length() - 1  # this line is in the sequence; its last place will do
                out.append(i - 1)
        end, first = first, first - step
    return out[::-1]


def nearness(path: str, other: str) -> int:
    """Leading path segments in common."""
    n = 0
    for a, b in zip(path.split("/"), other.split("/")):
        if a != b:
            break
        n += 1
    return n


def template_lines(page: tuple, *sides: tuple | None) -> list[bool]:
    """Which lines of ``page`` (host, path, digest, hashes) its nearest neighbours share."""
    host, path, _, lines = page
    near = [(nearness(path, s[1]), shared_lines(lines, s[3])) for s in sides if s is not None and s[0] == host]
    near = [(n, set(shared)) for n, shared in near if len(shared) < len(lines)]
    gone = set.intersection(*(shared for n, shared in near if n == max(k for k, _ in near))) if near else set()
    return [i in gone for i in range(len(lines))]


_PAGE = ("host", "path", "digest", "hashes")
_TOLD = "digest binary, shared array<boolean>, part int, nth long, asks boolean, host string, path string, hashes array<long>"


def _told(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.binary(), pa.list_(pa.bool_()), pa.int32(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.list_(pa.int64()))
    names = [c.split()[0] for c in _TOLD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(list(zip(*rows)) or [()] * len(names), types)], names=names)


def _aligned(batches):
    """Rows in order of (host, path): what each page shares, and the pages at either end of the task for the second pass."""
    part, nth = TaskContext.get().partitionId(), 0
    ends: dict[int, tuple] = {}
    before = page = None

    def edge(n: int, p: tuple, asks: bool) -> tuple:
        return (p[2], None, part, n, asks, p[0], p[1], p[3])

    for batch in batches:
        out = []
        for row in zip(*(batch.column(c).to_pylist() for c in _PAGE)):
            if nth >= 2:
                out.append((page[2], template_lines(page, before, row), None, None, None, None, None, None))
            if nth < 2:
                ends[nth] = row
            before, page, nth = page, row, nth + 1
        yield _told(out)
    if nth > 1:
        ends[nth - 2] = before
    if nth:
        ends[nth - 1] = page
    yield _told([edge(n, p, n in (0, nth - 1)) for n, p in sorted(ends.items())])


def _mended(batches):
    """The pages at the ends of tasks, in order: their neighbours are the rows next to them."""
    before = page = None
    for batch in batches:
        out = []
        for row in zip(*(batch.column(c).to_pylist() for c in (*_PAGE, "asks"))):
            if page is not None and page[4]:
                out.append((page[2], template_lines(page[:4], before, row[:4]), None, None, None, None, None, None))
            before, page = page and page[:4], row
        yield _told(out)
    if page is not None and page[4]:
        yield _told([(page[2], template_lines(page[:4], before), None, None, None, None, None, None)])


# ---------------------------------------------------------------- the job


def lines_of(pages: DataFrame) -> DataFrame:
    """(page_id, url, lines, says, places, hashes) of every page: the lines that may stay with their places among all, and the hashes of all."""

    def parse(batches):
        for batch in batches:
            rows = [page_lines(t or "") for t in batch.column("html").to_pylist()]
            hashes = [np.array([xxhash.xxh3_64_intdigest(x) for x in lines], dtype=np.uint64).view(np.int64) for lines, _ in rows]
            places = [[i for i, said in enumerate(says) if said != GOES] for _, says in rows]
            columns = [
                batch.column("page_id"),
                batch.column("url"),
                pa.array([[lines[i] for i in at] for at, (lines, _) in zip(places, rows)], pa.list_(pa.string())),
                pa.array([[says[i] for i in at] for at, (_, says) in zip(places, rows)], pa.list_(pa.int8())),
                pa.array(places, pa.list_(pa.int32())),
                pa.array(hashes, pa.list_(pa.int64())),
                pa.array([hashlib.blake2b(h.tobytes(), digest_size=16).digest() for h in hashes], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "lines", "says", "places", "hashes", "lines_digest"])

    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return picked.mapInArrow(parse, "page_id long, url string, lines array<string>, says array<tinyint>, places array<int>, hashes array<long>, lines_digest binary")


def alignments(pages: DataFrame, partitions: int | None = None) -> DataFrame:
    """(digest, shared) of the different pages of each host, from (host, path, digest, hashes)."""
    partitions = partitions or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    different = pages.where("host <> ''").groupBy("digest").agg(F.min(F.struct("host", "path", "hashes")).alias("page"))
    ordered = different.select("page.host", "page.path", "digest", "page.hashes").repartitionByRange(partitions, "host", "path", "digest")
    told = stage(ordered.sortWithinPartitions("host", "path", "digest").mapInArrow(_aligned, _TOLD), "aligned")
    ends = told.where("part is not null").repartition(1).sortWithinPartitions("part", "nth").mapInArrow(_mended, _TOLD)
    return told.where("part is null").select("digest", "shared").unionByName(ends.select("digest", "shared"))


def extract(pages: DataFrame, partitions: int | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    digest = F.unhex(F.md5(F.concat(F.col("host").cast("binary"), F.lit("\n").cast("binary"), F.col("lines_digest"))))
    named = parsed(lines_of(pages)).withColumns({"digest": digest, "salt": F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")})
    rows = stage(named.drop("lines_digest"), "lines")
    told = alignments(rows.select("host", "path", "digest", "hashes"), partitions)
    hangs = F.exists("says", lambda said: said == UNLESS_SHARED)  # whether some line hangs on the alignment; other texts need not travel
    salted = told.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    both = rows.where(hangs).select("page_id", "url", "lines", "says", "places", "digest", "salt").join(salted.hint("merge"), ["digest", "salt"], "left")
    shared = lambda i: F.coalesce(F.get("shared", F.get("places", i)), F.lit(False))
    stays = F.filter("lines", lambda line, i: (F.get("says", i) == STAYS) | ~shared(i))
    every = both.select("page_id", "url", stays.alias("lines")).unionByName(rows.where(~hangs).select("page_id", "url", "lines"))
    return every.select("page_id", "url", F.array_join("lines", "\n\n").alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
