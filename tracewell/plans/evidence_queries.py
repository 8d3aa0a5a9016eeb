"""Queries of source identity, continuity, term snippets, concepts, link evidence and reviews.

Cases are dealt by id modulo, so that every branch of an operator has rows; their SQL says the outcome of each.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import evidence as op
from tracewell.registry import query
from tracewell.sources.model import BLOCKS_SQL, OBJECTS_SQL, blocks, objects, table


def _cases(key, values):
    """The value of each case, by ``key`` modulo their number."""
    return F.element_at(F.array(*values), (key % len(values) + 1).cast("int"))


_SNAPSHOT_CASES = ("no snapshot", "selected response", "no original", "other original", "identical bytes", "no continuity", "other continuity", "verified response", "other response", "continuous render", "not continuous", "unknown basis")


@query(f"SELECT doc_id AS material, ({list(_SNAPSHOT_CASES)!r})[doc_id % 12 + 1] IN ('selected response', 'identical bytes', 'verified response', 'continuous render') AS matches, ({list(_SNAPSHOT_CASES)!r})[doc_id % 12 + 1] AS why FROM documents")
def j09_snapshot_match(spark, sf_dir):
    """Each document's digest as the expected response, with what was archived of it."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("material"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), (F.col("doc_id") % 12).alias("case"))
    other = F.sha2(F.concat("sha", F.lit("x")), 256)
    snap = F.when(F.col("case").isin(1, 4, 7), F.upper("sha")).otherwise(other)
    web = F.when(F.col("case") == 3, other).otherwise(F.col("sha"))
    held = docs.where("case <> 0").select("material", F.lit("snapshot.html").alias("name"), snap.alias("sha")).unionByName(docs.where("case > 2").select("material", F.lit("web-original.bin").alias("name"), web.alias("sha")))
    held = held.unionByName(docs.where("case <> 0").select("material", F.lit("snapshot.a").alias("name"), F.lit("0").alias("sha")))
    basis = F.when(F.col("case").isin(7, 8), "original_response").when(F.col("case").isin(9, 10), "browser_render").otherwise("guess")
    told = docs.where("case > 5").select(
        "material", F.col("sha").alias("original_sha"), F.when(F.col("case") == 6, "snapshot.a").otherwise("snapshot.html").alias("snapshot_name"), snap.alias("snapshot_sha"), basis.alias("basis"),
        F.when(F.col("case") == 10, "broken").otherwise("continuous").alias("status"), snap.alias("candidate_sha"), F.lit("source_content_continuity").alias("reason"),
    )
    return op.snapshot_matches(docs.select("material", "sha"), held, told)


_IDENTITY_CASES = ("url and response", "other url", "other response", "local bytes", "no local bytes", "no digest")


@query(f"SELECT page_id AS material, page_id % 6 IN (0, 3) AS matches, ({list(_IDENTITY_CASES)!r})[page_id % 6 + 1] AS why FROM pages")
def j10_source_identity(spark, sf_dir):
    """Each page as a project whose manifest names its URL in another spelling, another URL, other bytes, or a local file."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("material"), (F.col("page_id") % 6).alias("case"), F.sha2("html", 256).alias("sha"))
    place = F.concat(F.lit("https://example.org/p/"), "material")
    projects = pages.select("material", place.alias("source_url"))
    spelled = F.concat(F.lit("HTTPS://Example.org:443/p/"), "material", F.lit("/#top"))
    identities = pages.select(
        "material", F.when(F.col("case") == 5, "12").otherwise(F.upper("sha")).alias("sha"), F.when(F.col("case") < 3, F.lit("https://example.org/asked")).alias("url"), F.lit("").alias("preflight_url"),
        F.when(F.col("case").isin(0, 2), spelled).alias("final_url"), F.when(F.col("case") == 4, "b.txt").otherwise("a.txt").alias("local_name"),
    )
    name = F.when(F.col("case") < 3, "snapshot.html").otherwise("a.txt")
    held = pages.select("material", name.alias("name"), F.when(F.col("case") == 2, F.sha2("sha", 256)).otherwise(F.col("sha")).alias("sha"))
    return op.identity_matches(projects, identities, held)


_PLAIN = "lower(trim(regexp_replace(coalesce({}, ''), '\\s+', ' ', 'g')))"
_WORDS = "list_distinct(regexp_extract_all({}, '([a-z0-9]{{2,}}|\\p{{L}}{{2,}}|\\d+)', 1))"


@query(
    "WITH p AS (SELECT doc_id AS id, 'title ' || doc_id AS title, text, CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN '404 Not Found here' WHEN 2 THEN 'short one' WHEN 3 THEN repeat('entirely different phrases stand here now without relation whatsoever ok ', 40) "
    "ELSE left(text, length(text) // 2) END AS rendered, CASE doc_id % 5 WHEN 1 THEN '404 Not Found' ELSE 'other' END AS rendered_title FROM documents), "
    f"n AS (SELECT id, {_PLAIN.format('text')} AS t, {_PLAIN.format('rendered')} AS r, lower(title) AS a, lower(rendered_title) AS b FROM p), w AS (SELECT *, {_WORDS.format('t')} AS x, {_WORDS.format('r')} AS y FROM n), "
    "s AS (SELECT *, CASE WHEN len(x) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(x, y)) / len(x) END AS shared, length(t) >= 300 AND len(x) >= 24 AS solid FROM w) "
    "SELECT id, round(shared, 4) AS shared, CASE WHEN (NOT solid AND regexp_matches(b, '^404 not found$')) OR (regexp_matches(left(r, 5000), '\\b404 +not found\\b') AND shared < 0.30) THEN 'error page' "
    "WHEN solid AND length(r) < greatest(160, length(t) * 0.35) AND shared < 0.45 THEN 'lost' WHEN solid AND len(x) >= 50 AND len(y) >= 10 AND shared < 0.12 THEN 'content mismatch' "
    "WHEN solid AND a <> b AND shared < 0.2 THEN 'title mismatch' ELSE 'accepted' END AS verdict FROM s"
)
def j11_continuity(spark, sf_dir):
    """Each document against itself, an error page, a stub, other content, or its first half."""
    docs = table(spark, sf_dir, "documents")
    apart = "entirely different phrases stand here now without relation whatsoever ok " * 40
    half = F.expr("left(text, length(text) div 2)")
    rendered = _cases(F.col("doc_id"), [F.col("text"), F.lit("404 Not Found here"), F.lit("short one"), F.lit(apart), half])
    title = F.when(F.col("doc_id") % 5 == 1, "404 Not Found").otherwise("other")
    return op.continuity(docs.select(F.col("doc_id").alias("id"), F.concat(F.lit("title "), "doc_id").alias("title"), "text", title.alias("rendered_title"), rendered.alias("rendered_text")))


@query(
    "WITH i AS (SELECT doc_id AS item_id, doc_id % 6 AS k, text FROM documents), n AS (SELECT item_id, k, lower(trim(regexp_replace(string_split(text, chr(10))[1], '\\s+', ' ', 'g'))) AS s FROM i) "
    "SELECT item_id, 'url' AS matched FROM i WHERE k = 0 UNION ALL SELECT item_id, 'sha256' FROM i WHERE sha256(coalesce(text, '')) IN (SELECT sha256(coalesce(text, '')) FROM i WHERE k = 1) UNION ALL "
    "SELECT item_id, 'summary' FROM n WHERE length(s) >= 12 AND s IN (SELECT lower(trim(regexp_replace(l, '\\s+', ' ', 'g'))) FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM i WHERE k = 2)) UNION ALL SELECT item_id, 'unreadable' FROM i WHERE k = 4"
)
def j12_history_scan(spark, sf_dir):
    """Every document as a new item; of each six, earlier objects hold one by URL, one by bytes, one by its first line; one was planned, one unreadable."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), (F.col("doc_id") % 6).alias("k"), "text")
    url = F.concat(F.lit("https://Example.org/d/"), "item_id")
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    items = docs.select("item_id", url.alias("url"), sha.alias("sha"), F.get(F.split("text", "\n"), 0).alias("summary"))
    history = docs.where("k < 5").select(
        F.when(F.col("k").isin(0, 3, 4), F.concat(F.lower(url), F.lit("/#x"))).otherwise(F.lit("https://example.org/other")).alias("url"), F.when(F.col("k") == 1, sha).alias("sha"),
        F.when(F.col("k") == 2, F.col("text")).when(F.col("k") != 4, "").alias("text"), F.when(F.col("k") == 3, "planned").otherwise("created").alias("state"),
    )
    return op.known_before(items, history)


@query(
    "WITH t AS (SELECT doc_id AS term_id, text, CASE WHEN doc_id % 4 = 3 THEN 'no such term' ELSE regexp_extract(text, '[a-z]{3,}') END AS term, regexp_extract(text, ' ([A-Z][a-z]+)', 1) AS short FROM documents), "
    "p AS (SELECT *, string_split(text, term) AS parts FROM t WHERE term <> '' AND text IS NOT NULL), u AS (SELECT term_id, text, term, short, unnest(parts) AS s, generate_subscripts(parts, 1) AS k, len(parts) AS n FROM p), "
    "o AS (SELECT *, sum(length(s)) OVER (PARTITION BY term_id ORDER BY k) + length(term) * (k - 1) AS start FROM u), m AS (SELECT term_id, start, short, substr(text, greatest(start - 80, 0)::BIGINT + 1, (start - greatest(start - 80, 0))::BIGINT + 160) AS snippet FROM o WHERE k < n), "
    "b AS (SELECT *, row_number() OVER (PARTITION BY term_id ORDER BY (NOT (short <> '' AND contains(snippet, short)))::INT, start) AS nth FROM m) "
    "SELECT t.term_id, CASE WHEN b.term_id IS NULL THEN 'lookup_failed' ELSE 'found' END AS status, sha256(b.snippet) AS snippet_sha FROM t LEFT JOIN b ON b.term_id = t.term_id AND b.nth = 1"
)
def j16_evidence_snippets(spark, sf_dir):
    """A term of each document, its first longer word, beside its first capitalised one; every fourth term is nowhere."""
    docs = table(spark, sf_dir, "documents")
    term = F.when(F.col("doc_id") % 4 == 3, "no such term").otherwise(F.regexp_extract("text", "[a-z]{3,}", 0))
    terms = docs.select(F.col("doc_id").alias("term_id"), F.col("doc_id").alias("id"), term.alias("term"), F.regexp_extract("text", " ([A-Z][a-z]+)", 1).alias("short"))
    return op.term_snippets(terms, docs.select(F.col("doc_id").alias("id"), "text")).select("term_id", "status", F.sha2("snippet", 256).alias("snippet_sha"))


@query(
    "WITH a AS (SELECT p_partkey AS c, lower(replace(p_type, ' ', '')) AS zh, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE lower(replace(p_name, ' ', '')) END AS en FROM part WHERE p_partkey % 2 = 0), "
    "n AS (SELECT p_partkey AS c, CASE p_partkey % 6 WHEN 5 THEN 'own' || p_partkey ELSE lower(replace(p_type, ' ', '')) END AS zh, lower(replace(p_name, ' ', '')) AS en, p_partkey % 3 <> 0 AS verified FROM part WHERE p_partkey % 2 = 1), "
    "m AS (SELECT n.*, (SELECT min(a.c) FROM a WHERE a.zh = n.zh AND a.en = n.en) AS alias_of, (SELECT min(a.c) FROM a WHERE a.zh = n.zh AND a.en = '') AS completes FROM n) "
    "SELECT c AS concept, CASE WHEN alias_of IS NOT NULL THEN 'alias' WHEN completes IS NOT NULL AND verified THEN 'completion' ELSE 'new' END AS kind, CASE WHEN alias_of IS NOT NULL THEN alias_of WHEN completes IS NOT NULL AND verified THEN completes END AS of FROM m"
)
def j20_concept_coalescing(spark, sf_dir):
    """Parts as concepts, types and names as their names: even ones are accepted, half of them without the second name."""
    part = table(spark, sf_dir, "part")
    accepted = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("concept"), F.col("p_type").alias("chinese"), F.when(F.col("p_partkey") % 4 != 0, F.upper("p_name")).alias("english"))
    own = F.when(F.col("p_partkey") % 6 == 5, F.concat(F.lit("own"), "p_partkey")).otherwise(F.concat(F.lit(" "), "p_type"))
    new = part.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("concept"), own.alias("chinese"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("english"), (F.col("p_partkey") % 3 != 0).alias("verified"))
    return op.coalesced_concepts(new, accepted)


@query("SELECT page_id AS link_id, CASE WHEN page_id % 4 = 0 THEN sha256(left(html, 700)) END AS evidence_sha, CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'HTTP 404' WHEN 2 THEN 'unknown' ELSE 'not saved' END AS failure FROM pages WHERE page_id % 3 <> 0 AND page_id % 5 <> 0")
def j26_prefetched_evidence(spark, sf_dir):
    """A link to each page in another spelling; two in three are content, every fifth has evidence of its own target; of four pages one is saved."""
    pages = table(spark, sf_dir, "pages").withColumn("place", F.concat(F.lit("https://example.org/l/"), "page_id"))
    role = F.when(F.col("page_id") % 3 == 0, "reference").otherwise("content")
    links = pages.select(F.col("page_id").alias("link_id"), F.concat("place", F.lit("/#a")).alias("target"), role.alias("role"), F.when(F.col("page_id") % 5 == 0, F.col("place")).otherwise("https://example.org/").alias("evidence_url"))
    case = F.col("page_id") % 4
    saved = pages.where(case != 3).select(F.col("place").alias("url"), F.when(case == 0, F.col("html")).alias("text"), F.when(case == 1, "HTTP 404").alias("failure"))
    return op.prefetched(links, saved).select("link_id", F.sha2("evidence", 256).alias("evidence_sha"), "failure")


@query(
    "WITH b AS (SELECT doc_id, unnest([0, 1, 2]) AS n, text FROM documents), m AS (SELECT doc_id, n, CASE WHEN n = 0 AND doc_id % 2 = 0 THEN 'nowhere at all' ELSE substr(coalesce(text, ''), 3, 25) END AS quote, CASE WHEN n = 2 AND doc_id % 3 = 0 THEN 'internal' ELSE 'external' END AS kind, text FROM b) "
    "SELECT doc_id AS resolution, count(*) FILTER (NOT coalesce(kind = 'external' AND quote <> '' AND contains(text, quote), false)) AS bindings, "
    "CASE WHEN count(*) FILTER (NOT coalesce(kind = 'external' AND quote <> '' AND contains(text, quote), false)) = 0 THEN 'unresolved' ELSE 'resolved' END AS status FROM m GROUP BY doc_id"
)
def j27_misfiled_evidence(spark, sf_dir):
    """Three bindings for each document, most of which quote it."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("material"), F.col("doc_id").alias("resolution"), "text", F.explode(F.array(*map(F.lit, range(3)))).alias("n"))
    quote = F.when((F.col("n") == 0) & (F.col("material") % 2 == 0), "nowhere at all").otherwise(F.substring(F.coalesce("text", F.lit("")), 3, 25))
    kind = F.when((F.col("n") == 2) & (F.col("material") % 3 == 0), "internal").otherwise("external")
    bindings = rows.select("resolution", "material", kind.alias("kind"), quote.alias("quote"))
    _, told = op.without_misfiled(bindings, docs.select(F.col("doc_id").alias("resolution")), docs.select(F.col("doc_id").alias("material"), "text"))
    return told


@query("SELECT o_orderkey AS item FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey HAVING bool_and(p_size > 12))")
def j28_reference_pruning(spark, sf_dir):
    """Orders as gaps, their lines' parts as the links that own them, larger parts as reference links."""
    owners = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("link"))
    references = table(spark, sf_dir, "part").where("p_size > 12").select(F.col("p_partkey").alias("link"))
    return op.without_reference_links(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item")), owners, references)


@query("SELECT page_id, page_id % 3 <> 2 AS is_saved FROM pages")
def j30_target_saved(spark, sf_dir):
    """A link to each page, in another spelling or with another query; two in three of the pages are saved."""
    pages = table(spark, sf_dir, "pages").withColumn("place", F.concat(F.lit("http://example.org/s/"), "page_id"))
    links = pages.select("page_id", F.concat(F.lit("HTTP://EXAMPLE.org:80/s/"), "page_id", F.lit("//#f")).alias("target"))
    extra = F.when(F.col("page_id") % 3 == 2, "?other=1").otherwise("")
    return op.saved_targets(links, pages.select(F.concat("place", extra).alias("url"))).select("page_id", "is_saved")


@query(
    f"WITH {BLOCKS_SQL}, f AS (SELECT DISTINCT material_id, unnest([CASE WHEN material_id % 6 = 1 AND ord = 1 THEN 'block sets' END, CASE WHEN material_id % 6 = 2 AND ord = 1 THEN 'proof sets' END, CASE WHEN material_id % 6 = 3 AND ord = 1 THEN 'unsupported proof' END, "
    "CASE WHEN material_id % 6 = 4 AND ord = 1 THEN 'repeated proof' END, CASE WHEN material_id % 6 = 5 AND ord = 1 THEN 'error finding' END, CASE WHEN material_id % 6 = 5 AND ord = 1 THEN 'obligation sets' END]) AS fault FROM blocks) "
    "SELECT material_id AS material, count(fault) = 0 AS complete, coalesce(string_agg(fault, ', ' ORDER BY fault), '') AS faults FROM f GROUP BY material_id"
)
def a16_review_completeness(spark, sf_dir):
    """Conversations as drafts under review, of which five in six miss something at their first turn."""
    rows = blocks(spark, sf_dir).select(F.col("material_id").alias("material"), F.col("block_id").alias("id"), (F.col("material_id") % 6).alias("case"), (F.col("ord") == 1).alias("first"))
    kinds = F.explode(F.array(F.lit("block"), F.lit("obligation"))).alias("kind")
    required = rows.select("material", kinds, "id")
    assessed = rows.select("*", kinds).where("not (first and ((case = 1 and kind = 'block') or (case = 5 and kind = 'obligation')))").select("material", "kind", "id")
    weak = F.col("first") & (F.col("case") == 3)
    proofs = rows.where("not (first and case = 2)").select(
        "material", "id", F.col("id").alias("block_id"), F.lit("supported").alias("status"), F.lit("claim").alias("claim"), F.when(weak, " ").otherwise("method").alias("method"), F.lit("").alias("evidence"), F.lit("design").alias("kind"),
        F.explode(F.when(F.col("first") & (F.col("case") == 4), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("time"),
    ).select("material", F.col("id").alias("proof_id"), "block_id", "status", "claim", "method", "evidence", "kind")
    findings = rows.where("first and case in (4, 5)").select("material", F.when(F.col("case") == 5, "error").otherwise("note").alias("severity"))
    return op.complete_reviews(required, assessed, proofs, findings)


@query("SELECT page_id AS page, CASE WHEN page_id % 5 IN (1, 2, 4) THEN 'incomplete' WHEN page_id % 5 = 3 THEN 'needs_correction' ELSE 'verified' END AS verdict, CASE WHEN page_id % 5 = 3 THEN 2 ELSE 0 END AS gaps FROM pages")
def a36_visual_verdict(spark, sf_dir):
    """Seven checks of each page; one in five lacks a category, one has one twice, one has damage, one an unknown category."""
    n = F.col("n")
    case = F.col("page_id") % 5
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("n")).where(~((case == 1) & (n == 6)))
    category = F.when((case == 2) & (n == 6), "text").when((case == 4) & (n == 6), "mood").otherwise(F.element_at(F.array(*map(F.lit, op.VISUAL_CATEGORIES)), (n + 1).cast("int")))
    status = F.when((case == 3) & (n < 2), "damaged").when(n == 5, "not_applicable").otherwise("preserved")
    return op.visual_verdicts(rows.select(F.col("page_id").alias("page"), category.alias("category"), status.alias("status")))


@query(
    f"WITH {OBJECTS_SQL}, c AS (SELECT o_custkey AS material_id, CASE WHEN bool_and(o_orderstatus <> 'P') THEN sum(o_totalprice) END AS cost FROM orders GROUP BY 1), "
    "s AS (SELECT material_id, sum(length(text))::BIGINT AS chars, count(*) FILTER (kind IN ('table', 'formula')) AS visuals FROM objects GROUP BY 1) SELECT s.material_id, chars, visuals, round(cost, 2) AS cost, round(cost * 1000 / chars, 2) AS per_1000 FROM s LEFT JOIN c USING (material_id)"
)
def a40_material_summary(spark, sf_dir):
    """Documents, with the orders of the customer of their number as calls; open ones have no known amount."""
    costs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("material_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("amount"))
    found = op.material_summaries(objects(spark, sf_dir), costs)
    return found.withColumns({c: F.round(c, 2) for c in ("cost", "per_1000")})
