"""The queries of this package, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import best_fit, divergence, exact_dedup, html_text, language_model, mixing, packing, resampling, simhash, token_files, toxicity, url_filter, vector_graph
from .common import table

#: The rules that op3_url_filter applies.
URL_RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


def op1_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"), keep_copy=True)


def op3_url_filter(spark, sf_dir):
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op4_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op5_vector_graph(spark, sf_dir):
    return vector_graph.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op6_token_files(spark, sf_dir):
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op7_language_model(spark, sf_dir):
    return language_model.score_documents(table(spark, sf_dir, "documents"))


def op8_toxicity(spark, sf_dir):
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_html_text(spark, sf_dir):
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op10_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_resampling(spark, sf_dir):
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_best_fit(spark, sf_dir):
    return best_fit.pack_best_fit(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_mixing, op3_url_filter, op4_exact_dedup, op5_vector_graph, op6_token_files, op7_language_model, op8_toxicity, op9_html_text, op10_simhash, op11_divergence, op12_resampling, op13_best_fit)}

#: Words of letters and digits, A-Z lower-cased.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op2_mixing": """
        WITH sizes AS (
            SELECT source, coalesce(sum(length(text)), 0)::DOUBLE AS chars FROM documents GROUP BY source
        ), totals AS (
            SELECT sum(chars) AS chars, sum(pow(chars, 0.7)) FILTER (chars > 0) AS weight FROM sizes
        ), rates AS (
            SELECT source, CASE WHEN s.chars > 0 THEN pow(s.chars, 0.7) / t.weight * t.chars / s.chars ELSE 1.0 END AS rate
            FROM sizes s, totals t
        ), cdf AS (
            SELECT source, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
            FROM rates, range(0, 200) x(k)
        ), listed AS (
            SELECT source, list(c) AS cs FROM cdf GROUP BY source
        ), drawn AS (
            SELECT d.*, cs, ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 AS u
            FROM documents d JOIN listed l ON d.source IS NOT DISTINCT FROM l.source
        ), counted AS (
            SELECT * EXCLUDE (cs, u), len(list_filter(cs, lambda c: c <= u)) AS n FROM drawn
        ), copies AS (
            SELECT * EXCLUDE (n), unnest(range(0, n))::INT AS copy FROM counted WHERE n > 0
        )
        SELECT *, md5('17|' || coalesce(doc_id::VARCHAR, '') || '|' || copy || '|order') AS shuffle_key FROM copies
    """,
    "op3_url_filter": """
        WITH rules(r_host, r_path, r_verdict) AS (
            VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
        ), cut AS (
            SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), parts AS (
            SELECT page_id,
                   translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM cut
        ), fits AS (
            SELECT page_id, host, path, r_host || r_path AS rule, r_verdict,
                   row_number() OVER (PARTITION BY page_id ORDER BY length(r_host || r_path) DESC NULLS LAST, length(r_host) DESC) AS k
            FROM parts LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
        )
        SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict FROM fits WHERE k = 1
    """,
    "op4_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_divergence": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), placed AS (
            SELECT d, lang, source, unnest(w) AS term FROM docs
        ), kept AS (
            SELECT lang, term, count(*) AS n FROM placed GROUP BY ALL HAVING count(DISTINCT d) >= 3
        ), counts AS (
            SELECT lang, source, term, count(*) AS n FROM placed SEMI JOIN kept USING (lang, term) GROUP BY ALL
        ), groups AS (
            SELECT DISTINCT lang, source FROM docs
        ), sizes AS (
            SELECT lang, count(*) AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY lang
        ), totals AS (
            SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(sum(c.n), 0)::HUGEINT AS n
            FROM groups g LEFT JOIN sizes USING (lang) LEFT JOIN counts c USING (lang, source) GROUP BY ALL
        ), p AS (
            SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (t.n + t.v))::BIGINT AS p,
                   (1 + 1000000000::HUGEINT * (k.n + 1) // (s.n + s.v))::BIGINT AS q
            FROM totals t JOIN kept k USING (lang) JOIN sizes s USING (lang) LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
        ), summed AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), pairs AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
        ), terms AS (
            SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
        )
        SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
    """,
    "op12_resampling": f"""
        WITH crc_table AS (
            SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, step: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) x(i)
        ), worded AS (
            SELECT doc_id, {_WORDS} AS w FROM documents
        ), goal AS (
            SELECT {_WORDS} AS w FROM benchmark
        ), placed AS (
            SELECT doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM worded
        ), aimed AS (
            SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM goal
        ), counted AS (
            SELECT doc_id, f, count(*) AS n FROM placed GROUP BY ALL
        ), features AS (
            SELECT DISTINCT f FROM counted UNION SELECT DISTINCT f FROM aimed
        ), bucketed AS (
            SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, strlen(f)), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT)),
                          lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket
            FROM features, crc_table
        ), own AS (
            SELECT bucket, sum(n) AS s FROM counted JOIN bucketed USING (f) GROUP BY bucket
        ), target AS (
            SELECT bucket, count(*) AS t FROM aimed JOIN bucketed USING (f) GROUP BY bucket
        ), gains AS (
            SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM own) + 10000)::DOUBLE
                                           / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM target) + 10000)::DOUBLE)))::BIGINT AS gain
            FROM range(10000) x(bucket) LEFT JOIN own USING (bucket) LEFT JOIN target USING (bucket)
        ), sums AS (
            SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total FROM counted JOIN bucketed USING (f) JOIN gains USING (bucket) GROUP BY doc_id
        ), weighed AS (
            SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features,
                   coalesce(total // n_features - (total % n_features < 0)::INT, 0)::BIGINT AS weight,
                   ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
            FROM worded LEFT JOIN sums USING (doc_id)
        ), scored AS (
            SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weighed
        ), ranked AS (
            SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM scored WHERE n_words >= 20
        )
        SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN r <= 25 * (SELECT count(*) FROM ranked) // 100 THEN r END AS rank
        FROM scored LEFT JOIN ranked USING (doc_id)
    """,
}
