"""For each query the equivalent SQL, written from the definitions and independent of the operators."""

from __future__ import annotations

from html.entities import name2codepoint

from ..functions.collections import SCRIPTS
from .files import LINKED, TITLE
from .queries import CONTEXT, STOP, WINDOW

_STOP = ", ".join(f"'{w}'" for w in STOP)


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def words(text: str = "text") -> str:
    return rf"list_filter(regexp_split_to_array(coalesce({text}, ''), '\s+'), lambda x: x <> '')"


def _chain(column: str, pairs) -> str:
    for old, new in pairs:
        column = f"replace({column}, {_quote(old)}, {_quote(new)})"
    return column


# The cleaning rules, as in the text functions.
_CLEAN = [("==", " "), ("[[", " "), ("]]", " "), ("|", " "), ("[", " "), ("]", " "), ("*", ""), ("{", ""), ("}", ""), ("=", ""), (",", ""), (".", ""), (":", " "), ("\n", " "), (";", ""), ("(", " "), (")", " "), ("?", " "), ('"', " "), ("\t", " "), ("'", " "), ("/", "")]
_KEEP = [("==", " "), ("[[", " "), ("]]", " "), ("|", " "), ("[", " "), ("]", " "), ("*", ""), ("{", ""), ("}", ""), ("=", ""), ("\n", " "), ("\t", " "), ("/", "")]


def _strip_wiki(text: str) -> str:
    text = rf"regexp_replace({text}, '\[\[Image.*?\]\]', '', 'g')"
    text = rf"regexp_replace({text}, '\[\[[^|\]]*\|([^|\]]*)(?:\|[^\]]*)?\]\]', '\1', 'g')"
    text = rf"regexp_replace({text}, '\[\[([^\]]*)\]\]', '\1', 'g')"
    text = rf"regexp_replace({text}, '\{{\{{.*?\}}\}}', '', 'g')"
    return rf"regexp_replace({text}, '\{{*?\}}', '', 'g')"


def _keep(text: str, spaced: bool) -> str:
    text = _chain(_strip_wiki(_chain(text, [("\n", " <CR> ")])), _KEEP)
    if spaced:
        text = _chain(text, [(c, f" {c} ") for c in ";()?\",.:"])
    return rf"regexp_replace({text}, '\s+', ' ', 'g')"


#: The entities of HTML 4, from their definition.
_NAMED = "MAP {" + ", ".join(f"'{name}': {code}" for name, code in name2codepoint.items()) + "}"


def _decode(text: str) -> str:
    """One level of entities: what follows each '&' is cut into a reference and the rest."""
    cut = f"list_transform(string_split({text}, '&')[2:], lambda x: {{'x': x, 'n': regexp_extract(x, '^(#[0-9]+|#x[0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);', 1)}})"
    code = f"CASE WHEN s.n LIKE '#x%' THEN TRY_CAST('0x' || s.n[3:] AS BIGINT) WHEN s.n LIKE '#%' THEN TRY_CAST(s.n[2:] AS BIGINT) ELSE {_NAMED}[s.n] END"
    coded = f"list_transform({cut}, lambda s: {{'x': s.x, 'n': s.n, 'c': {code}}})"
    known = "s.c BETWEEN 0 AND 1114111 AND NOT s.c BETWEEN 55296 AND 57343"
    return f"(string_split({text}, '&')[1] || array_to_string(list_transform({coded}, lambda s: CASE WHEN {known} THEN chr(s.c::INT) || s.x[length(s.n) + 2 :] ELSE '&' || s.x END), ''))"


def _strip_html(text: str) -> str:
    return f"array_to_string(list_transform(regexp_split_to_array({text}, '<[^>]*>'), lambda part: {_decode('part')}), '')"


def _uniform(key: str) -> str:
    return f"(('0x' || substr(md5({key}), 1, 13))::BIGINT / 4503599627370496.0)"


def _script_runs() -> str:
    """Code points of each character, the script of each by range, the last known one so far, and runs of equal ones."""
    script = " ".join(f"WHEN ord(c) BETWEEN {a} AND {b} THEN '{name}'" for name, a, b in SCRIPTS)
    return rf"""WITH chars AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM documents WHERE text <> ''),
        told AS (SELECT *, CASE WHEN regexp_matches(c, '^[\x09-\x0D ]$') THEN NULL {script} END AS own FROM chars),
        known AS (SELECT *, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i), 'latin') AS s FROM told),
        cut AS (SELECT *, CASE WHEN s = lag(s) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS new FROM known),
        numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM cut)
        SELECT doc_id, run::BIGINT AS run, any_value(s) AS script, string_agg(c, '' ORDER BY i) AS text FROM numbered GROUP BY doc_id, run"""


_EXTRANEOUS = "list_filter(string_split({}, ' '), lambda x: NOT regexp_matches(x, '^[0-9\\-$]'))"

_W = f"tokens AS (SELECT doc_id, doc_id::VARCHAR AS title, source, lang, {words()} AS w FROM documents)"
_TERMS = f"{_W}, long AS (SELECT * FROM tokens WHERE len(w) > 100), every AS (SELECT doc_id, unnest(w) AS word FROM long), terms AS (SELECT word, count(*) AS tf, count(DISTINCT doc_id) AS df FROM every GROUP BY word)"
_HEADS = f"{_TERMS}, heads AS (SELECT word FROM terms WHERE df >= 5 AND word NOT IN ({_STOP}) AND df * 10 >= (SELECT count(*) FROM long) * 4)"
_PLACED = f"{_HEADS}, kept AS (SELECT doc_id, lang, list_filter(w, lambda x: x NOT IN ({_STOP})) AS w FROM long), placed AS (SELECT doc_id, lang, w, unnest(w) AS head, generate_subscripts(w, 1) AS i FROM kept), found AS (SELECT * FROM placed WHERE head IN (SELECT word FROM heads))"
_BAG = f"bag AS (SELECT source AS head, unnest({words()}) AS feature FROM documents)"
_COUNTED = "vectors AS (SELECT head, feature, count(*) AS cnt FROM bag GROUP BY ALL)"
_VECTORS = f"{_BAG}, {_COUNTED}"
_WIKI = f"wiki(title, raw) AS (SELECT {TITLE}, {LINKED} FROM documents), linked AS (SELECT title, raw, regexp_extract_all(raw, '\\[\\[.*?\\]\\]') AS links, regexp_matches(raw[:20], '#redirect|#REDIRECT') AS redirect FROM wiki)"
_EDGES = """edges AS (SELECT DISTINCT url AS src, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS dst FROM pages), ends AS (SELECT dst AS doc, 1 AS i, 0 AS o FROM edges UNION ALL SELECT src, 0, 1 FROM edges), degree AS (SELECT doc, sum(i)::BIGINT AS incoming, sum(o)::BIGINT AS outgoing FROM ends GROUP BY doc)"""
_PAIRS = f"""singles AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents),
    placed AS (SELECT doc_id, w, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM singles),
    near AS (SELECT doc_id, word, unnest(w[greatest(i - {WINDOW // 2}, 1) : least(i + {WINDOW // 2 - 1}, len(w))]) AS word2 FROM placed),
    pairs AS (SELECT word, word2, count(*) AS cooc, count(DISTINCT doc_id) AS docs FROM near GROUP BY word, word2 HAVING count(*) >= 5 AND count(DISTINCT doc_id) >= 5)"""
_GAPS = f"{_PLACED}, gaps AS (SELECT head, array_to_string(w[greatest(i - 1, 1) : i - 1] || ['<>'] || w[i + 1 : i + 1], '_') AS context FROM found)"
_UNI = f"near AS (SELECT {{}} head, unnest(w[greatest(i - {CONTEXT + 1}, 1) : i - 1] || w[i + 1 : i + {CONTEXT}]) AS feature FROM found), counted AS (SELECT head, feature, count(*) AS cnt FROM near {{}} GROUP BY head, feature)"
_REVISIONS = """revisions AS (SELECT event_type || ' ' || (event_id // 50) AS title, event_id AS revid,
    CASE WHEN user_id % 7 = 0 THEN 'bot' || user_id WHEN user_id % 11 = 0 THEN '10.0.0.1' ELSE 'user' || user_id END AS usr, user_id % 11 = 0 AS anon, round(value)::BIGINT AS size FROM events)"""


def _jaccard(weights: str) -> str:
    return _jaccard_of(_BAG, weights)


def _jaccard_of(bag: str, weights: str) -> str:
    return f"""WITH {bag}, {_COUNTED}, weights AS ({weights}), heads AS (SELECT DISTINCT head FROM weights),
        pairs AS (SELECT a.head, b.head AS target FROM heads a, heads b WHERE a.head <> b.head),
        sums AS (SELECT head, sum(weight) AS total FROM weights GROUP BY head),
        tops AS (SELECT a.head, b.head AS target, sum(least(a.weight, b.weight)) AS top FROM weights a JOIN weights b USING (feature) WHERE a.head <> b.head GROUP BY ALL)
        SELECT head, target, round(coalesce(top, 0) / (s.total + t.total - coalesce(top, 0)), 6) AS score
        FROM pairs LEFT JOIN tops USING (head, target) JOIN sums s USING (head) JOIN sums t ON t.head = target"""


_TF = "SELECT head, feature, cnt::DOUBLE AS weight FROM vectors"
_MASS = "SELECT head, feature, cnt / sum(cnt) OVER (PARTITION BY feature) AS weight FROM vectors"
_BY_VECTORS = "SELECT head, feature, cnt / count(*) OVER (PARTITION BY feature) AS weight FROM vectors"
_TTEST = """SELECT head, feature, CASE WHEN a = 0 THEN 0 ELSE (cnt / n - a) / sqrt(a) END AS weight FROM (
    SELECT *, types / n * (mass / n) AS a FROM (SELECT head, feature, cnt::DOUBLE AS cnt, sum(cnt) OVER ()::DOUBLE AS n,
    count(*) OVER (PARTITION BY head)::DOUBLE AS types, sum(cnt) OVER (PARTITION BY feature)::DOUBLE AS mass FROM vectors))"""

ORACLE_SQL = {
    "term_doc_freq": f"WITH {_TERMS} SELECT word, tf, df FROM terms WHERE df >= 5",
    "corpus_totals": f"WITH {_W} SELECT count(*) AS n_docs, coalesce(sum(len(w)), 0)::BIGINT AS n_words FROM tokens WHERE len(w) > 100",
    "min_len_docs": f"WITH {_W} SELECT doc_id, len(w)::BIGINT AS n_words FROM tokens WHERE len(w) > 1000",
    "vocab_filter": f"WITH {_TERMS} SELECT word, tf, df FROM terms WHERE df > 10",
    "stopword_removal": f"WITH {_W}, kept AS (SELECT doc_id, list_filter(w, lambda x: x NOT IN ({_STOP})) AS w FROM tokens) SELECT doc_id, len(w)::BIGINT AS n_words, md5(array_to_string(w, ' ')) AS digest FROM kept",
    "in_degree_docs": f"WITH {_EDGES} SELECT DISTINCT dst AS title FROM edges WHERE dst IN (SELECT doc FROM degree WHERE incoming >= 5)",
    "category_restriction": f"WITH {_WIKI} SELECT title FROM wiki WHERE regexp_matches(raw, 'Category:.*Letters.*') OR regexp_matches(raw, 'Category:.*Pict.*')",
    "strip_html_pages": f"SELECT page_id, {_strip_html(_strip_html('html'))} AS text FROM pages",
    "clean_document": f"SELECT doc_id, {_chain('text', _CLEAN)} AS text FROM documents",
    "clean_keep_punct": f"SELECT doc_id, {_keep('text', True)} AS text FROM documents",
    "strip_wiki": f"WITH {_WIKI} SELECT title, {_strip_wiki(_chain('raw', [(chr(10), ' <CR> ')]))} AS text FROM wiki",
    "extraneous_filter": f"SELECT doc_id, array_to_string({_EXTRANEOUS.format(_keep('text', False))}, ' ') AS text FROM documents",
    "strict_filter": f"SELECT doc_id, array_to_string(list_filter({_EXTRANEOUS.format(_keep('text', False))}, lambda x: regexp_matches(x, '^[A-Za-z]+$')), ' ') AS text FROM documents",
    "redirect_flag": f"WITH {_WIKI} SELECT title, redirect, len(links)::BIGINT AS n_links FROM linked",
    "plain_text_truncated": rf"WITH {_W} SELECT title, regexp_extract(array_to_string(w[1:100], ' '), '(?s)^(.*\.)', 1) AS text FROM tokens WHERE len(w) > 100",
    "key_hashes": """SELECT doc_id, list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(':' || doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
        lambda h, c: xor((h * 33) & 4294967295, c)) AS h FROM documents""",
    "normalized_titles": "SELECT p_partkey, upper(trim(p_name)[1]) || trim(p_name)[2:] AS title FROM part",
    "link_graph": f"WITH {_WIKI} SELECT DISTINCT CASE WHEN redirect AND len(links) <= 4 THEN 'REDIRECT' ELSE 'NORMAL' END AS kind, title AS src, x[3:-3] AS dst FROM (SELECT *, unnest(links) AS x FROM linked) WHERE x[3:-3] <> ''",
    "page_links": f"WITH {_EDGES} SELECT 'NORMAL' AS kind, src, dst FROM edges",
    "degree_table": f"WITH {_EDGES} SELECT doc, incoming, outgoing FROM degree",
    "category_graph": rf"WITH {_WIKI}, found AS (SELECT title, unnest(CASE WHEN title LIKE 'Category:%' THEN regexp_extract_all(trim(raw), '(?m)^\[\[Category:.*?\]\]') ELSE regexp_extract_all(raw, '\[\[Category:.*?\]\]') END) AS x FROM wiki WHERE title NOT LIKE 'Image:%' AND title NOT LIKE 'Wikipedia:%') SELECT DISTINCT title, x[3:-3] AS category FROM found",
    "missing_languages": rf"""WITH {_WIKI}, rows AS (SELECT title, len({words('raw')})::BIGINT AS n_words, list_sort(list_filter(['fr', 'de', 'ja', 'zh', 'it', 'pl', 'es', 'ru', 'pt', 'nl'], lambda l: NOT list_contains(list_transform(links, lambda x: regexp_extract(x, '^\[\[([a-z][a-z]):', 1)), l))) AS m FROM linked)
        SELECT title, n_words, len(m)::BIGINT AS n_missing, array_to_string(m, ',') AS missing FROM rows WHERE n_words > 3 AND len(m) > 0""",
    "redirect_resolution": rf"""WITH RECURSIVE {_WIKI}, r AS (SELECT title AS src, trim(regexp_extract(regexp_extract(raw, '(?i)^#redirect:?\s*?\[\[(.*?)\]\]', 1), '^([^|#]*)', 1)) AS dst FROM wiki WHERE regexp_matches(raw, '(?i)^#redirect:?\s*?\[\[')),
        walk(src, dst, hops) AS (SELECT src, dst, 1 FROM r UNION ALL SELECT w.src, r.dst, hops + 1 FROM walk w JOIN r ON w.dst = r.src WHERE hops < 40)
        SELECT src, dst, hops::BIGINT AS hops FROM walk WHERE dst NOT IN (SELECT src FROM r)""",
    "cooccurrence": f"WITH {_PAIRS} SELECT word, word2, cooc, docs FROM pairs",
    "pmi": f"""WITH {_PAIRS}, f AS (SELECT word, sum(cooc) AS f FROM pairs GROUP BY word), b AS (SELECT sum(cooc) AS b FROM pairs)
        SELECT p.word, p.word2, round(ln(cooc * b::DOUBLE / (x.f::DOUBLE * y.f)), 6) AS pmi, cooc, docs FROM pairs p JOIN f x ON x.word = p.word JOIN f y ON y.word = p.word2, b""",
    "contexts_uni": f"WITH {_PLACED}, {_UNI.format('', '')} SELECT * FROM counted WHERE feature IN (SELECT word FROM terms WHERE df >= 5)",
    "contexts_raw": f"WITH {_PLACED} SELECT head, array_to_string(w[greatest(i - {CONTEXT}, 1) : i - 1] || ['###' || head || '###'] || w[i + 1 : i + {CONTEXT - 1}], ' ') AS context FROM found",
    "contexts_lr": f"WITH {_GAPS} SELECT head, context, count(*) AS cnt FROM gaps GROUP BY ALL",
    "context_unique_words": f"WITH {_GAPS} SELECT context, count(DISTINCT head) AS n_words FROM gaps GROUP BY context HAVING count(DISTINCT head) >= 2",
    "context_vectors": f"WITH {_HEADS}, placed AS (SELECT doc_id, lang, w, unnest(w) AS head, generate_subscripts(w, 1) AS i FROM long), found AS (SELECT * FROM placed WHERE head IN (SELECT word FROM heads)), {_UNI.format('', '')} SELECT * FROM counted WHERE feature IN (SELECT word FROM terms WHERE df >= 5)",
    "lda_docs_document": f"""WITH {_TERMS}, big AS (SELECT title, w FROM tokens WHERE len(w) > 1000), rows AS (SELECT title AS doc_id, unnest(w) AS word FROM big)
        SELECT doc_id, word, count(*) AS cnt FROM rows WHERE word IN (SELECT word FROM terms WHERE df > 10) GROUP BY ALL
        UNION ALL SELECT title, NULL, 0 FROM big WHERE NOT EXISTS (SELECT 1 FROM rows JOIN terms USING (word) WHERE df > 10 AND rows.doc_id = title)""",
    "lda_docs_ngram": f"""WITH {_TERMS}, big AS (SELECT title, w FROM tokens WHERE len(w) > 1000), starts AS (SELECT title, w, unnest(range(0, len(w) - 10)) AS i FROM big),
        rows AS (SELECT title || '-' || i || '-' || (i + 10) AS doc_id, unnest(w[i + 1 : i + 10]) AS word FROM starts)
        SELECT doc_id, word, count(*) AS cnt FROM rows WHERE word IN (SELECT word FROM terms WHERE df > 10) GROUP BY ALL""",
    "esa_postings": f"""WITH {_TERMS}, sized AS (SELECT title, w, len(w)::BIGINT AS doc_len, len(list_distinct(w))::BIGINT AS vocab_size FROM long),
        rows AS (SELECT title, unnest(w) AS word FROM long), postings AS (SELECT word, title, count(*) AS tf FROM rows WHERE word IN (SELECT word FROM terms WHERE df >= 5) GROUP BY ALL)
        SELECT word, title, tf, doc_len, vocab_size FROM postings JOIN sized USING (title)""",
    "esa_doc_stats": f"WITH {_W} SELECT title, len(w)::BIGINT AS doc_len, len(list_distinct(w))::BIGINT AS vocab_size FROM tokens WHERE len(w) > 100",
    "weight_tf": f"WITH {_VECTORS} {_TF}",
    "weight_tfidf_mass": f"WITH {_VECTORS} SELECT head, feature, round(weight, 6) AS weight FROM ({_MASS})",
    "weight_tfidf_df": f"WITH {_VECTORS} SELECT head, feature, round(weight, 6) AS weight FROM ({_BY_VECTORS})",
    "weight_ttest": f"WITH {_VECTORS} SELECT head, feature, round(weight, 6) AS weight FROM ({_TTEST})",
    "jaccard": _jaccard("SELECT head, feature, 1.0::DOUBLE AS weight FROM vectors"),
    "weighted_jaccard_tf": _jaccard(_TF),
    "weighted_jaccard_tfidf": _jaccard(_MASS),
    "weighted_jaccard_ttest": _jaccard(_TTEST),
    "topk_neighbors": f"SELECT head, target, score FROM ({_jaccard(_TF)}) QUALIFY row_number() OVER (PARTITION BY head ORDER BY score DESC, target DESC) <= 5",
    "context_whitelist": f"WITH {_TERMS}, {_VECTORS} SELECT head, feature, cnt FROM vectors WHERE feature IN (SELECT word FROM terms WHERE df >= 50)",
    "sense_overwrite": f"""WITH {_VECTORS} SELECT head, feature, cnt FROM vectors WHERE head NOT IN ('src1', 'src2')
        UNION ALL SELECT source || 'ZZZ' || lang, feature, count(*) FROM (SELECT source, lang, unnest({words()}) AS feature FROM documents WHERE source IN ('src1', 'src2')) GROUP BY ALL""",
    "contextual_similarity": f"""WITH {_TERMS}, {_VECTORS}, stats AS (SELECT word, df FROM terms WHERE df >= 5),
        placed AS (SELECT w, unnest(w) AS target, generate_subscripts(w, 1) AS i FROM long), found AS (SELECT * FROM placed WHERE target IN (SELECT word FROM stats WHERE df >= 300)),
        near AS (SELECT target, unnest(list_distinct(w[greatest(i - {CONTEXT}, 1) : i - 1] || w[i + 1 : i + {CONTEXT - 1}])) AS feature FROM found),
        weighed AS (SELECT target, feature, count(*) AS n, any_value(df) AS df FROM near JOIN stats ON word = feature GROUP BY target, feature),
        whole AS (SELECT target, sum(n) AS jb, sum(n / df) AS wb FROM weighed GROUP BY target),
        shared AS (SELECT head, target, sum(n) AS jt, sum(n / df) AS wt FROM weighed JOIN vectors USING (feature) GROUP BY ALL),
        pairs AS (SELECT h.head, t.target FROM (SELECT DISTINCT head FROM vectors) h, (SELECT DISTINCT target FROM found) t WHERE h.head <> t.target)
        SELECT head, target, coalesce(jt, 0)::BIGINT AS jt, coalesce(jb, 0)::BIGINT AS jb, round(coalesce(wt, 0), 6) AS wt, round(coalesce(wb, 0), 6) AS wb,
               round(coalesce(jt, 0) / jb, 6) AS jacc, round(coalesce(wt, 0) / wb, 6) AS wjacc
        FROM pairs LEFT JOIN whole USING (target) LEFT JOIN shared USING (head, target)""",
    "parse_sparse_vector": f"WITH {_VECTORS} SELECT head, feature, cnt FROM vectors",
    "format_sparse_vector": f"WITH {_VECTORS} SELECT head || chr(9) || string_agg(feature || ':' || cnt, chr(9) ORDER BY feature) AS value FROM vectors GROUP BY head",
    "authors": f"WITH {_REVISIONS} SELECT title, CASE WHEN anon AND usr = '10.0.0.1' THEN 'ANONIPEDITS' ELSE usr END AS author, count(*) AS n_edits FROM revisions WHERE (anon AND usr = '10.0.0.1') OR NOT regexp_matches(usr, '(?i)bot') GROUP BY ALL",
    "size_changes": f"WITH {_REVISIONS} SELECT title, revid, abs(size - coalesce(lag(size) OVER (PARTITION BY title ORDER BY revid), 0)) AS diff_size FROM revisions",
    "expressions": "SELECT p_partkey, (p_size * 2 + 3 - (1 < p_size)::INT)::DOUBLE AS value FROM part",
    "collection_items": "SELECT c_nationkey::VARCHAR AS page, c_mktsegment AS chapter, c_name AS title FROM customer",
    "sample_docs": f"SELECT doc_id FROM documents WHERE {_uniform("'1|' || doc_id || '|' || coalesce(text, '')")} < 0.5",
    "random_similarity": f"WITH heads AS (SELECT source AS head FROM documents WHERE len({words()}) > 0 GROUP BY source) SELECT a.head, b.head AS target, round({_uniform("'0|' || a.head || '|' || b.head")}, 6) AS score FROM heads a, heads b WHERE a.head <> b.head",
    "script_runs": _script_runs(),
    "article_urls": rf"""WITH parts AS (SELECT page_id, regexp_extract(url, '[?&]title=([^&#]*)', 1) AS q, regexp_extract(url, '^[a-z]+://[^/?#]+(?:/[^?#]*)?/([^/?#]*)', 1) AS p FROM pages)
        SELECT page_id, nullif(replace(url_decode(CASE WHEN q <> '' THEN q ELSE p END), '_', ' '), '') AS title FROM parts""",
    "overlay_docs": "SELECT doc_id::VARCHAR AS title, md5(CASE WHEN lang = 'de' THEN '+' || text ELSE text END) AS digest FROM documents",
    "stream_term_counts": f"WITH {_TERMS} SELECT word, tf, df FROM terms",
    "stream_windowed_counts": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
