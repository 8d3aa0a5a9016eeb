"""Evidence: identity of sources, continuity of renderings, term snippets, concepts, link evidence, reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.scalars import canonical_url
from tracewell.operators.text import occurrences

# What an error page says, and categories of a visual check.
ERROR_PAGE = r"\b(403 +error|404 +not found|502 +bad gateway|503 +service unavailable|access denied|request could not be satisfied|this site can.t be reached)\b"
ERROR_TITLE = r"^(403 +error|404 +not found|502 +bad gateway|503 +service unavailable|access denied)$"
VISUAL_CATEGORIES = ("text", "reading_order", "tables", "formulas", "figures", "captions", "footnotes")


# The size of a substantive source, and when a rendering breaks with it.
SOLID_SOURCE = {"chars": 300, "words": 24}
BREAK_BELOW = {"error page": 0.30, "lost": 0.45, "content mismatch": 0.12, "title mismatch": 0.20}
LOST_CHARS, LOST_SHARE = 160, 0.35
MISMATCH_WORDS = {"of": 50, "to": 10}
ERROR_SEARCHED = 5000


# ---------------------------------------------------------------- identity of sources


def snapshot_matches(expected: DataFrame, originals: DataFrame, continuity: DataFrame) -> DataFrame:
    """(material, matches, why): whether a web snapshot is bound to the verified original response.

    ``expected(material, sha)``, ``originals(material, name, sha)``, ``continuity(material, original_sha, snapshot_name, snapshot_sha, basis, status, candidate_sha,
    reason)``.  Of several snapshots ``snapshot.html`` counts, else the first by name.
    """
    is_snapshot = F.col("name").startswith("snapshot.")
    held = originals.groupBy("material").agg(
        F.min(F.when(is_snapshot, F.struct((F.col("name") != "snapshot.html").alias("other"), "name", F.lower("sha").alias("sha")))).alias("snap"),
        F.min(F.when(F.col("name") == "web-original.bin", F.lower("sha"))).alias("web"),
    )
    told = continuity.select("material", F.struct(*(c for c in continuity.columns if c != "material")).alias("told"))
    met = expected.hint("merge").join(held, "material", "left").join(told.hint("merge"), "material", "left")
    same = lambda a, b: F.lower(F.coalesce(a, F.lit(""))) == F.coalesce(b, F.lit(""))
    wanted, snap, web = F.lower("sha"), F.col("snap.sha"), F.col("web")
    bound = same(F.col("told.original_sha"), web) & (F.col("told.snapshot_name") == F.col("snap.name")) & same(F.col("told.snapshot_sha"), snap)
    accepted = (F.col("told.status") == "continuous") & same(F.col("told.candidate_sha"), snap) & (F.col("told.reason") == "source_content_continuity")
    why = (
        F.when(F.col("snap").isNull(), "no snapshot")
        .when(web.isNull(), F.when(snap == wanted, "selected response").otherwise("no original"))
        .when(web != wanted, "other original")
        .when(F.col("told").isNull(), F.when(snap == web, "identical bytes").otherwise("no continuity"))
        .when(~F.coalesce(bound, F.lit(False)), "other continuity")
        .when(F.col("told.basis") == "original_response", F.when(snap == web, "verified response").otherwise("other response"))
        .when(F.col("told.basis") == "browser_render", F.when(F.coalesce(accepted, F.lit(False)), "continuous render").otherwise("not continuous"))
        .otherwise("unknown basis")
    )
    return met.select("material", why.isin("selected response", "identical bytes", "verified response", "continuous render").alias("matches"), why.alias("why"))


def identity_matches(projects: DataFrame, identities: DataFrame, originals: DataFrame) -> DataFrame:
    """(material, matches, why): whether a project holds the URL and bytes, or the local bytes, that a manifest names.

    ``projects(material, source_url)``, ``identities(material, sha, url, preflight_url, final_url, local_name)``, ``originals(material, name, sha)``.
    """
    held = originals.groupBy("material").agg(F.collect_set(F.struct("name", F.lower("sha").alias("sha"))).alias("held"))
    met = identities.hint("merge").join(projects, "material", "left").join(held.hint("merge"), "material", "left")
    sha = F.lower("sha")
    allowed = F.filter(F.array("url", "preflight_url", "final_url"), lambda u: F.coalesce(F.trim(u), F.lit("")) != "")
    known = F.array_contains(F.transform(allowed, lambda u: canonical_url(u)), canonical_url(F.col("source_url")))
    is_response = lambda o: (o["name"] == "web-original.bin") | o["name"].startswith("snapshot.")
    web = F.coalesce(F.exists("held", lambda o: is_response(o) & (o["sha"] == sha)), F.lit(False))
    named = lambda o: F.coalesce(F.col("local_name"), F.lit("")).isin("") | (o["name"] == F.col("local_name"))
    local = F.coalesce(F.exists("held", lambda o: (o["sha"] == sha) & named(o)), F.lit(False))
    why = (
        F.when(~F.coalesce(sha.rlike("^[0-9a-f]{64}$"), F.lit(False)), "no digest")
        .when(F.coalesce(F.trim("url"), F.lit("")) != "", F.when(~F.coalesce(known, F.lit(False)), "other url").when(~web, "other response").otherwise("url and response"))
        .otherwise(F.when(local, "local bytes").otherwise("no local bytes"))
    )
    return met.select("material", why.isin("url and response", "local bytes").alias("matches"), why.alias("why"))


def continuity(pairs: DataFrame) -> DataFrame:
    """(id, shared, verdict) of (id, title, text, rendered_title, rendered_text): whether a rendering goes on with its source.

    ``shared`` is the share of the source's different words that the rendering keeps.  Only a source of ``SOLID_SOURCE`` size can be lost or
    mismatched.  Each kind of break has the share below which it holds and a sign of its own; the first that holds is the verdict.
    """
    plain = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " ")))
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"([a-z0-9]{2,}|\p{L}{2,}|\d+)"), F.lit(1)))
    size = lambda c: F.struct(F.char_length(c).alias("chars"), F.size(words(F.col(c))).alias("words"))
    rows = pairs.select("id", *(plain(c).alias(c) for c in ("title", "text", "rendered_title", "rendered_text")))
    kept = F.size(F.array_intersect(words(F.col("text")), words(F.col("rendered_text"))))
    rows = rows.withColumns({"of": size("text"), "to": size("rendered_text"), "kept": kept})
    rows = rows.withColumn("shared", F.when(F.col("of.words") == 0, 1.0).otherwise(F.col("kept") / F.col("of.words")))
    solid = (F.col("of.chars") >= SOLID_SOURCE["chars"]) & (F.col("of.words") >= SOLID_SOURCE["words"])
    signs = {
        "error page": F.left("rendered_text", F.lit(ERROR_SEARCHED)).rlike(ERROR_PAGE),
        "lost": solid & (F.col("to.chars") < F.greatest(F.lit(LOST_CHARS), LOST_SHARE * F.col("of.chars"))),
        "content mismatch": solid & (F.col("of.words") >= MISMATCH_WORDS["of"]) & (F.col("to.words") >= MISMATCH_WORDS["to"]),
        "title mismatch": solid & (F.least(F.char_length("title"), F.char_length("rendered_title")) > 0) & (F.col("title") != F.col("rendered_title")),
    }
    thin_error = ~solid & F.col("rendered_title").rlike(ERROR_TITLE)
    breaks = [F.when(thin_error, F.lit("error page")), *(F.when(signs[kind] & (F.col("shared") < below), F.lit(kind)) for kind, below in BREAK_BELOW.items())]
    return rows.select("id", F.round("shared", 4).alias("shared"), F.coalesce(*breaks, F.lit("accepted")).alias("verdict"))


def known_before(items: DataFrame, history: DataFrame, least: int = 12) -> DataFrame:
    """(item_id, matched): items that earlier objects already hold, by canonical URL, by digest, or by their normal summary as the normal text of one.

    ``items(item_id, url, sha, summary)``, ``history(url, sha, text, state)``; rows that were only planned don't count, and those that could
    not be read (null text) count against every item of their URL as ``unreadable``.  Summaries under ``least`` characters match nothing.
    """
    past = history.where(F.col("state") != "planned")
    normal = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    key = F.sha2(F.col("normal"), 256)

    def found(name: str, mine: Column, rows: DataFrame, theirs: Column) -> DataFrame:
        seen = rows.select(theirs.alias("key")).where("key is not null").distinct()
        return items.select("item_id", mine.alias("key")).hint("merge").join(seen, "key", "left_semi").select("item_id", F.lit(name).alias("matched"))

    summaries = items.withColumn("normal", normal("summary")).where(F.char_length("normal") >= least)
    lines = past.select(F.explode(F.split("text", "\n")).alias("line")).hint("merge").withColumn("normal", normal("line")).where(F.char_length("normal") >= least)
    by_summary = summaries.select("item_id", key.alias("key")).hint("merge").join(lines.select(key.alias("key")).distinct(), "key", "left_semi").select("item_id", F.lit("summary").alias("matched"))
    read = past.where("text is not null")
    by_url = found("url", canonical_url(F.col("url")), read, canonical_url(F.col("url")))
    unread = found("unreadable", canonical_url(F.col("url")), past.where("text is null"), canonical_url(F.col("url")))
    return by_url.unionByName(found("sha256", F.col("sha"), read, F.col("sha"))).unionByName(by_summary).unionByName(unread)


# ---------------------------------------------------------------- terms and concepts


def term_snippets(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """(term_id, status, snippet): 80 characters before to 160 after the first match that has the abbreviation nearby, else the first match.

    ``terms(term_id, id, term, short)``, ``texts(id, text)``; a term that its text does not hold, or without a text, is ``lookup_failed``.
    """
    held = terms.hint("merge").join(texts, "id").where(F.coalesce("term", F.lit("")) != "")
    hits = occurrences(held, ["term_id", "text", "short"], "text", F.col("term"))
    first = F.greatest(F.col("start") - 80, F.lit(0))
    snippet = F.substring("text", first + 1, F.col("start") - first + 160)
    near = F.coalesce(F.contains(F.col("snippet"), F.col("short")) & (F.col("short") != ""), F.lit(False))
    best = hits.withColumn("snippet", snippet).groupBy("term_id").agg(F.min(F.struct((~near).alias("apart"), "start", "snippet")).alias("best"))
    met = terms.select("term_id").hint("merge").join(best, "term_id", "left")
    return met.select("term_id", F.when(F.col("best").isNull(), "lookup_failed").otherwise("found").alias("status"), F.col("best.snippet").alias("snippet"))


def name_identity(name: Column) -> Column:
    """Lower case without white space and dashes; null is empty."""
    return F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), r"[\s\p{Pd}]", ""))


def coalesced_concepts(new: DataFrame, accepted: DataFrame) -> DataFrame:
    """(concept, kind, of): new concepts that are an accepted one's alias, complete its name, or are new.

    ``new(concept, chinese, english, verified)``, ``accepted(concept, chinese, english)``.  Both names equal: an alias.  Equal Chinese names, an
    accepted one without an English name and verified evidence: its name is completed.  Of several the first accepted one counts.
    """
    known = accepted.select(F.col("concept").alias("of"), name_identity(F.col("chinese")).alias("zh"), name_identity(F.col("english")).alias("en"))
    pairs = known.groupBy("zh", "en").agg(F.min("of").alias("alias_of"))
    bare = known.where("en = '' and zh <> ''").groupBy("zh").agg(F.min("of").alias("completes"))
    asked = new.withColumns({"zh": name_identity(F.col("chinese")), "en": name_identity(F.col("english"))})
    met = asked.hint("merge").join(pairs, ["zh", "en"], "left").join(bare.hint("merge"), "zh", "left")
    completes = F.col("completes").isNotNull() & (F.col("en") != "") & F.coalesce("verified", F.lit(False))
    kind = F.when(F.col("alias_of").isNotNull(), "alias").when(completes, "completion").otherwise("new")
    return met.select("concept", kind.alias("kind"), F.when(kind == "alias", F.col("alias_of")).when(kind == "completion", F.col("completes")).alias("of"))


# ---------------------------------------------------------------- link evidence


def saved_targets(links: DataFrame, saved: DataFrame) -> DataFrame:
    """Links with ``is_saved``: whether their canonical target is an archived page, of ``saved(url)``."""
    known = saved.select(canonical_url(F.col("url")).alias("canonical")).where("canonical is not null").distinct().withColumn("known", F.lit(True))
    met = links.withColumn("canonical", canonical_url(F.col("target"))).hint("merge").join(known, "canonical", "left")
    return met.withColumn("is_saved", F.coalesce("known", F.lit(False))).drop("canonical", "known")


def prefetched(links: DataFrame, saved: DataFrame, limit: int = 700) -> DataFrame:
    """(link_id, evidence, failure) of content links(link_id, target, role, evidence_url) whose evidence isn't from their own target.

    ``saved(url, text, failure)``: the first characters of the saved target page, or why there is none.
    """
    own = F.coalesce(canonical_url(F.col("evidence_url")) == canonical_url(F.col("target")), F.lit(False))
    asked = links.where((F.col("role") == "content") & ~own).select("link_id", canonical_url(F.col("target")).alias("canonical"))
    pages = saved.groupBy(canonical_url(F.col("url")).alias("canonical")).agg(F.min(F.struct(F.col("text").isNull().alias("missing"), "text", "failure")).alias("page"))
    met = asked.hint("merge").join(pages, "canonical", "left")
    failure = F.when(F.col("page").isNull(), "not saved").when(F.col("page.missing"), F.coalesce("page.failure", F.lit("unknown")))
    return met.select("link_id", F.when(failure.isNull(), F.left("page.text", F.lit(limit))).alias("evidence"), failure.alias("failure"))


def without_misfiled(bindings: DataFrame, resolutions: DataFrame, originals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bindings left, resolutions with ``status``): external bindings whose quote stands in the original are none.

    ``bindings(resolution, material, kind, quote)``, ``resolutions(resolution)``, ``originals(material, text)``; what is left without a binding is unresolved.
    """
    met = bindings.hint("merge").join(originals, "material", "left")
    misfiled = (F.col("kind") == "external") & (F.col("quote") != "") & F.contains("text", F.col("quote"))
    left = met.where(~F.coalesce(misfiled, F.lit(False))).drop("text")
    n = left.groupBy("resolution").agg(F.count("*").alias("bindings"))
    counted = resolutions.hint("merge").join(n, "resolution", "left").withColumn("bindings", F.coalesce("bindings", F.lit(0)))
    return left, counted.withColumn("status", F.when(F.col("bindings") == 0, "unresolved").otherwise("resolved"))


def without_reference_links(items: DataFrame, owners: DataFrame, references: DataFrame) -> DataFrame:
    """``items(item)`` that are owned by some link that is no reference link, or by none at all: ``owners(item, link)``, ``references(link)``."""
    marked = owners.hint("merge").join(references.select("link").distinct().withColumn("is_reference", F.lit(True)).hint("merge"), "link", "left")
    only = marked.groupBy("item").agg(F.bool_and(F.coalesce("is_reference", F.lit(False))).alias("only")).where("only").select("item")
    return items.hint("merge").join(only, "item", "left_anti")


# ---------------------------------------------------------------- reviews


def complete_reviews(required: DataFrame, assessed: DataFrame, proofs: DataFrame, findings: DataFrame) -> DataFrame:
    """(material, complete, faults): no error; assessed sets and proof blocks equal the required ones; proofs once, supported and founded.

    ``required(material, kind, id)`` and ``assessed(material, kind, id)`` of kinds obligation and block; ``proofs(material, proof_id, block_id, status, claim, method,
    evidence, kind)``; ``findings(material, severity)``.
    """
    proven = proofs.select("material", F.lit("proof").alias("kind"), F.col("block_id").alias("id"))
    wanted = required.unionByName(required.where("kind = 'block'").withColumn("kind", F.lit("proof"))).distinct().withColumn("wanted", F.lit(True))
    have = assessed.select("material", "kind", "id").unionByName(proven).distinct().withColumn("have", F.lit(True))
    uneven = wanted.hint("merge").join(have, ["material", "kind", "id"], "full").where("wanted is null or have is null").select("material", F.concat(F.col("kind"), F.lit(" sets")).alias("fault"))
    founded = (F.col("evidence") != "") | F.col("kind").isin("mathematical", "example", "design")
    sound = (F.col("status") == "supported") & (F.trim("claim") != "") & (F.trim("method") != "") & founded
    weak = proofs.where(~F.coalesce(sound, F.lit(False))).select("material", F.lit("unsupported proof").alias("fault"))
    twice = proofs.groupBy("material", "proof_id").count().where("count > 1").select("material", F.lit("repeated proof").alias("fault"))
    errors = findings.where("severity = 'error'").select("material", F.lit("error finding").alias("fault"))
    faults = uneven.unionByName(weak).unionByName(twice).unionByName(errors).groupBy("material").agg(F.array_sort(F.collect_set("fault")).alias("faults"))
    met = required.select("material").distinct().hint("merge").join(faults, "material", "left")
    return met.select("material", F.col("faults").isNull().alias("complete"), F.coalesce(F.array_join("faults", ", "), F.lit("")).alias("faults"))


def visual_verdicts(checks: DataFrame) -> DataFrame:
    """(page, verdict, gaps) of (page, category, status): every category exactly once, else incomplete; all preserved or not applicable, else in need of correction."""
    found = checks.groupBy("page").agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("category").isin(*VISUAL_CATEGORIES), F.col("category"))).alias("known"), F.count_if(~F.col("status").isin("preserved", "not_applicable")).alias("gaps"))
    whole = (F.col("n") == len(VISUAL_CATEGORIES)) & (F.col("known") == len(VISUAL_CATEGORIES))
    return found.select("page", F.when(~whole, "incomplete").when(F.col("gaps") > 0, "needs_correction").otherwise("verified").alias("verdict"), "gaps")


def material_summaries(objects: DataFrame, costs: DataFrame) -> DataFrame:
    """(material_id, chars, visuals, cost, per_1000): source characters, visual objects, the known cost and that for 1,000 characters.

    ``costs(material_id, amount)``; a material with an unknown (null) amount, or without a call, has no cost.
    """
    sizes = objects.groupBy("material_id").agg(F.sum(F.char_length("text")).cast("long").alias("chars"), F.count_if(F.col("kind").isin("image", "table", "formula", "media")).alias("visuals"))
    spent = costs.groupBy("material_id").agg(F.when(F.bool_and(F.col("amount").isNotNull()), F.sum("amount")).alias("cost"))
    met = sizes.hint("merge").join(spent, "material_id", "left")
    return met.withColumn("per_1000", F.when(F.col("chars") > 0, F.col("cost") * 1000 / F.col("chars")))


