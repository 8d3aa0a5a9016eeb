"""Registered queries of this subpackage: thin wrappers over its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    import public_tokenizers

    from tracewell.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every document once each 20-word passage stays only where it starts first."""
    from tracewell.llm.substring_dedup import factor

    return factor(_table(spark, sf_dir, "documents")).drop("factors")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    from tracewell.llm.simhash import clustered, hex_digits

    found = clustered(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_digits("fp").alias("fingerprint"), "component_id")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base counts and digests, and all spans."""
    from tracewell.llm.pii import detect, digest

    return digest(detect(_table(spark, sf_dir, "documents")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of a document that is nearly a benchmark item."""
    from tracewell.llm.decontamination import hits

    return hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


#: The rules of the registered URL query.
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, longest rule and verdict of every page."""
    from tracewell.llm.url_filter import judged

    rows = ", ".join(str(r) for r in URL_RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {rows} AS rules(rule_host, rule_path, rule_verdict)")
    return judged(_table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = """
WITH cut AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parsed AS (
    SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(h, p, v) AS (
    VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fits AS (
    SELECT page_id, host, path, h || p AS rule, v,
           row_number() OVER (PARTITION BY page_id ORDER BY length(h) + length(p) DESC NULLS LAST) AS nth
    FROM parsed LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM fits WHERE nth = 1
"""


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from tracewell.llm.html_text import extract

    return extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; a third of them is held out from training."""
    from tracewell.llm.language_id import held_out, identify, train

    docs = _table(spark, sf_dir, "documents")
    apart = held_out("doc_id", 3, 1)
    found = identify(docs, train(docs.where(~apart).select("doc_id", "text", "lang")))
    return found.select("doc_id", apart.alias("held_out"), "lang_pred", "score")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; a quarter of them is held out from training."""
    from tracewell.llm.language_id import held_out
    from tracewell.llm.quality_classifier import scored, train

    docs = _table(spark, sf_dir, "documents")
    apart = held_out("doc_id", 4, 2)
    found = scored(docs, train(docs, _table(spark, sf_dir, "labels").where(~apart)))
    return found.select("doc_id", apart.alias("held_out"), "score", "predicted")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document, the base rules and the learned verdict."""
    from tracewell.llm.quality_rules import judged, learned_list

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = learned_list(docs, _table(spark, sf_dir, "labels"))
    return judged(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of each language."""
    from tracewell.llm.collocations import collocations

    return collocations(_table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH cut AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), pieces AS (
    SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM cut
), places AS (
    SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces
), grams AS (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM places, range(1, 6) AS lengths(k) WHERE i + k - 1 <= len(w)
), f AS (
    SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY ALL HAVING count(*) >= 100
), totals AS (
    SELECT lang, count(*) AS n FROM places GROUP BY lang
), cuts AS (
    SELECT c.lang, c.phrase, c.n AS a, t.n, l.n AS l, r.n AS r, cut.c AS place, CAST((1000 * CAST(c.n AS HUGEINT) * t.n) // (CAST(l.n AS HUGEINT) * r.n) AS BIGINT) AS score
    FROM f AS c JOIN totals AS t ON t.lang = c.lang, range(1, 5) AS cut(c),
         f AS l, f AS r
    WHERE c.k >= 2 AND cut.c < c.k AND l.lang = c.lang AND r.lang = c.lang
      AND l.phrase = array_to_string(string_split(c.phrase, ' ')[1:cut.c], ' ') AND r.phrase = array_to_string(string_split(c.phrase, ' ')[cut.c + 1:], ' ')
), lowest AS (
    SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, place) AS nth FROM cuts
), kept AS (
    SELECT * FROM lowest AS c WHERE nth = 1 AND NOT EXISTS (
        SELECT 1 FROM f AS longer WHERE longer.lang = c.lang AND longer.phrase <> c.phrase AND 100 * longer.n >= 100 * c.a AND contains(' ' || longer.phrase || ' ', ' ' || c.phrase || ' '))
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's shingle set, and its component of near-equal sets."""
    from tracewell.llm.jaccard_join import clustered

    return clustered(_table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH RECURSIVE words AS (
    SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
    SELECT row, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words
), shingles AS (
    SELECT row, len(s) AS n, unnest(s) AS x FROM sets
), links AS (
    SELECT a.row AS a, b.row AS b FROM shingles AS a JOIN shingles AS b ON a.x = b.x AND a.row <> b.row
    GROUP BY a.row, b.row, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reached(a, b) AS (
    SELECT row, row FROM sets UNION SELECT reached.a, links.b FROM reached JOIN links ON links.a = reached.b
), least AS (
    SELECT reached.a AS row, min(doc_id) AS component_id FROM reached JOIN sets ON sets.row = reached.b GROUP BY reached.a
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets JOIN least USING (row)
"""


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents of every benchmark item."""
    from tracewell.llm.lexical_search import search

    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP13_SQL = """
WITH cut AS (
    SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents
), docs AS (
    SELECT row, doc_id, len(t) AS n, t FROM cut WHERE len(t) > 0
), whole AS (
    SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM docs
), tf AS (
    SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(t) AS term FROM docs) GROUP BY ALL
), asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark
), weights AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY term, n_docs
), scores AS (
    SELECT item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
    FROM asked JOIN tf USING (term) JOIN weights USING (term), whole GROUP BY item_id, row, doc_id
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    found = (
        op1_best_fit_packing, op2_substring_dedup, op3_html_extraction, op4_language_id, op5_quality_classifier, op6_pii,
        op7_simhash_near_dedup, op8_url_filters, op9_quality_rules, op10_decontamination,
        op11_collocations, op12_jaccard_join, op13_lexical_search, pipeline,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict:
    return {"op8_url_filters": OP8_SQL, "op11_collocations": OP11_SQL, "op12_jaccard_join": OP12_SQL, "op13_lexical_search": OP13_SQL}
