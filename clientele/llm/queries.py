"""Named queries of the training-data operators and the SQL that checks them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (best_fit, collocations, decontaminate, fingerprint, language_id, minhash_dedup, mix_sources, pack_tokens,
               source_divergence, substring_dedup, toxicity, url_filter, warc)
from .common import prepare, shared_path, table


def _remainder(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document (model fitted on the other three quarters)."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs, where=_remainder(4) != 2)
    held = docs.select("doc_id", "text", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"))
    return language_id.predict(held, model, keep=["doc_id", "held_out"])


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hit words and items of every document that holds a 10-word window of a benchmark item."""
    prepare(spark)
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op3_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as packed token-id sequences of 2048."""
    prepare(spark)
    return pack_tokens.pack(table(spark, sf_dir, "documents"))


# The rules every page is judged by (host, path prefix, action).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, deciding rule and verdict of every page."""
    prepare(spark)
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document in the mix of sources weighted by count ** 0.7."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix_sources.mix(docs, mix_sources.source_weights(docs), carry=["doc_id"]).select("row.doc_id", F.col("*")).drop("row")


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, with their likeness and that of the next document."""
    prepare(spark)
    return fingerprint.edited_pairs(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document (model fitted on two thirds of the labels)."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), where=_remainder(3) != 1)
    held = docs.select("doc_id", "text", F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out"))
    return toxicity.score(held, model, keep=["doc_id", "held_out"])


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    prepare(spark)
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length, digest and record type of every page after a round through WARC archives."""
    prepare(spark)
    path = shared_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document once all 400-byte strings that repeat are removed."""
    prepare(spark)
    # The remaining bytes as text; a character that the edge of a removed run cuts shows as a replacement mark.
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).withColumn(
        "kept_text", F.expr("make_valid_utf8(cast(kept as string))")).drop("kept")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source's distance from the others of its language, and the terms that mark it off."""
    prepare(spark)
    return source_divergence.divergence(table(spark, sf_dir, "documents"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence and offset of every piece of every document, packed into sequences of 4096 tokens."""
    prepare(spark)
    return best_fit.pack(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of two and three words of each language."""
    prepare(spark)
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_decontaminate": op2_decontaminate,
    "op3_pack_tokens": op3_pack_tokens,
    "op4_url_filter": op4_url_filter,
    "op5_mix_sources": op5_mix_sources,
    "op6_fingerprint": op6_fingerprint,
    "op7_toxicity": op7_toxicity,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_warc": op9_warc,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_collocations": op13_collocations,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORDS = "coalesce(regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"

ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": rf"""
        WITH d AS (SELECT doc_id, {_WORDS.format(_LOWER.format("text"))} AS w FROM documents),
        i AS (SELECT item_id, {_WORDS.format(_LOWER.format("text"))} AS w FROM benchmark),
        iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k,
                   unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda p: array_to_string(w[p:p + least(10, len(w)) - 1], ' '))) AS g
               FROM i WHERE len(w) > 0),
        dw AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS p, unnest(list_transform(range(1, len(w) - k + 2),
                   lambda p: array_to_string(w[p:p + k - 1], ' '))) AS g
               FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k),
        hit AS (SELECT doc_id, p, dw.k, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.k = iw.k),
        covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY 1),
        found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
                  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op4_url_filter": f"""
        WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        rules(host, path, action) AS (VALUES {", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in URL_RULES)}),
        fits AS (SELECT p.page_id, r.host || r.path AS rule, action,
                        row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k
                 FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
        SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.action, 'allow') AS verdict
        FROM p LEFT JOIN fits f ON f.page_id = p.page_id AND f.k = 1""",
    # Sources in name order with whole weights, earliest deadline first by recursion (one block a step), and every
    # document's place by arithmetic.  A block's rank is (deadline, source); nothing released: on to the next release.
    "op5_mix_sources": """
        WITH RECURSIVE n AS (SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1),
        l AS (SELECT list(s ORDER BY s) AS s, list(CAST((n + b - 1) // b AS BIGINT) ORDER BY s) AS n, list(n // b ORDER BY s) AS full_n,
                     list(CAST(floor(pow(n, 0.7) * 1000) AS BIGINT) ORDER BY s) AS w, sum(CAST(floor(pow(n, 0.7) * 1000) AS BIGINT))::BIGINT AS total, any_value(b) AS b
              FROM n, (SELECT greatest(16, (count(*) + 131071) // 131072) AS b FROM documents)),
        edf AS (
            SELECT CAST(-1 AS BIGINT) AS slot, list_transform(w, lambda v: CAST(0 AS BIGINT)) AS c, CAST(0 AS BIGINT) AS pick FROM l
            UNION ALL
            SELECT t0, list_transform(c, lambda v, i: CASE WHEN i = p THEN v + 1 ELSE v END), p
            FROM (SELECT t0, c, list_min(list_transform(list_filter(range(1, len(w) + 1), lambda i: c[i] < n[i] AND (c[i] * total) // w[i] <= t0),
                             lambda i: (((c[i] + 1) * total + w[i] - 1) // w[i]) * 10000 + i)) % 10000 AS p
                  FROM (SELECT edf.c, l.*, greatest(slot + 1, list_min(list_transform(list_filter(range(1, len(w) + 1), lambda i: c[i] < n[i]),
                             lambda i: (c[i] * total) // w[i]))) AS t0 FROM edf, l) WHERE t0 IS NOT NULL AND list_sum(list_transform(range(1, len(w) + 1), lambda i: n[i] - c[i])) > 0)),
        run AS (SELECT l.s[pick] AS s, c[pick] - 1 AS block, slot, ((c[pick] - 1) * total) // w[pick] AS release, (c[pick] * total + w[pick] - 1) // w[pick] AS deadline
                FROM edf, l WHERE slot >= 0),
        dry AS (SELECT list_min(list_transform(range(1, len(w) + 1), lambda i: (full_n[i] * total) // w[i])) AS t FROM l),
        d AS (SELECT doc_id, coalesce(source, '') AS s, row_number() OVER (PARTITION BY coalesce(source, '')
                     ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|mix')) - 1 AS number FROM documents)
        SELECT doc_id, d.s AS source, run.block, run.release, run.deadline, run.slot, CAST(number % l.b AS INTEGER) AS place,
               run.slot < (SELECT t FROM dry) AS in_target
        FROM l, d JOIN run ON run.s = d.s AND run.block = number // (SELECT b FROM l)""",
    "op8_minhash_dedup": rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_n
                   FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
                 WHERE 100 * both_n >= 75 * (x.n + y.n - both_n)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents
                  UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
        c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
        FROM documents d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op9_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS digest FROM p),
        o AS (SELECT n, digest, max(page_id) AS origin FROM d WHERE n >= 1000 GROUP BY ALL)
        SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
               CASE WHEN o.origin <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN o.origin <> d.page_id THEN o.origin END AS refers_to
        FROM d LEFT JOIN o ON o.n = d.n AND o.digest = d.digest""",
    "op11_source_divergence": rf"""
        WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        t AS (SELECT i, lang, source, unnest(w) AS term FROM d),
        kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY ALL HAVING count(DISTINCT i) >= 3),
        c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY lang),
        g AS (SELECT d.lang, d.source, coalesce(any_value(s.n), 0)::HUGEINT AS n, coalesce(any_value(v.v), 0)::HUGEINT AS v
              FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) s USING (lang, source)
              LEFT JOIN v ON v.lang = d.lang GROUP BY ALL),
        p AS (SELECT g.lang, g.source, k.term, k.n AS lang_n, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n + g.v) AS p
              FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        pair AS (SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum(((x.p - y.p) * (x.p - y.p)) // y.p)
                   FROM p x JOIN p y ON x.term = y.term WHERE x.lang = a.lang AND x.source = a.source AND y.lang = b.lang AND y.source = b.source), 0) AS value
                 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
        q AS (SELECT kept.lang, term, 1 + (1000000000::HUGEINT * (kept.n + 1)) // (v.n + v.v) AS q FROM kept JOIN v ON v.lang = kept.lang),
        term AS (SELECT p.lang, p.source, p.term AS item, ((p - q) * (p - q)) // q AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term
                 WHERE p.n > 0 AND p > q),
        r AS (SELECT *, 'pair' AS part FROM pair UNION ALL SELECT *, 'term' FROM term)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
               CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
        FROM r QUALIFY part = 'pair' OR rank <= 200""",
    "op13_collocations": rf"""
        WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, 'und') AS lang, {_LOWER.format("coalesce(text, '')")} AS t FROM documents),
        s AS (SELECT i, lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS t FROM d),
        w AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM s),
        g AS (SELECT lang, 1 AS m, unnest(w) AS g FROM w
              UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda p: array_to_string(w[p:p + 1], ' '))) FROM w
              UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda p: array_to_string(w[p:p + 2], ' '))) FROM w),
        f AS (SELECT lang, m, g, count(*)::HUGEINT AS f FROM g GROUP BY ALL HAVING m = 1 OR count(*) >= 10),
        n AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
        cut AS (SELECT lang, m, g, f AS a, string_split(g, ' ') AS w, unnest(range(1, m)) AS k FROM f WHERE m > 1),
        scored AS (SELECT c.lang, c.m, c.g, c.a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f * y.f) AS score
                   FROM cut c JOIN f x ON x.lang = c.lang AND x.g = array_to_string(w[1:k], ' ')
                   JOIN f y ON y.lang = c.lang AND y.g = array_to_string(w[k + 1:], ' ')),
        worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
        inside AS (SELECT lang, g, max(a) AS longer FROM (SELECT lang, f AS a, unnest([array_to_string(string_split(g, ' ')[1:2], ' '),
                     array_to_string(string_split(g, ' ')[2:3], ' ')]) AS g FROM f WHERE m = 3) GROUP BY ALL),
        kept AS (SELECT worst.* FROM worst LEFT JOIN inside USING (lang, g) WHERE longer IS NULL OR 100 * longer < 50 * a)
        SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, CAST(a AS BIGINT) AS a,
               CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM kept JOIN n ON n.lang = kept.lang QUALIFY rank <= 2000""",
}
