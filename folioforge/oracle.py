"""SQL of the core queries for an independent engine, over the same tables."""

from __future__ import annotations

from folioforge.operators.validation import ACADEMIC as _ACADEMIC
from folioforge.operators.validation import TEMPLATE_STARTS as _STARTS

_Q = "(SELECT DISTINCT ON (id) * FROM questions)"
_R = "(SELECT DISTINCT ON (result_id) * FROM evaluation_results)"
_L = "(SELECT DISTINCT ON (load_id) * FROM loaded_documents)"
_T = "(SELECT DISTINCT ON (record_id) * FROM token_records)"


def _number(column: str) -> str:
    return rf"CAST(regexp_extract({column}, '(\d+)$', 1) AS BIGINT)"


_ASKED = f"(SELECT * FROM golden_qa WHERE {_number('id')} % 20 = 0 AND question IS NOT NULL)"


def _terms(text: str) -> str:
    words = rf"list_filter(regexp_extract_all(regexp_replace({text}, '\p{{Han}}', ' ', 'g'), '[\p{{L}}\p{{N}}]+'), lambda w: length(w) > 1)"
    pairs = rf"flatten([[substr(r, i, 2) for i in range(1, length(r))] for r in regexp_extract_all({text}, '\p{{Han}}+')])"
    return f"list_concat({words}, {pairs})"


def _bare(text: str) -> str:
    return rf"regexp_replace(lower(coalesce({text}, '')), '[\s\v]', '', 'g')"


def _pairs_of(bare: str) -> str:
    return f"CASE WHEN length({bare}) = 1 THEN [{bare}] ELSE list_distinct([substr({bare}, i, 2) for i in range(1, length({bare}))]) END"


def _bm25(table: str, key: str, text: str, k: int, queries: str = _ASKED, query_key: str = "id", query_text: str = "question") -> str:
    """CTEs ending in ``hits`` (query_key, key, score, rank)."""
    return f"""
    docs AS (SELECT {key}, {_terms(text)} AS terms FROM {table}),
    stats AS (SELECT count(*) AS n, avg(coalesce(len(terms), 0)) AS avgdl FROM docs),
    post AS (SELECT term, {key}, count(*) AS tf, any_value(dl) AS dl
             FROM (SELECT {key}, len(terms) AS dl, unnest(terms) AS term FROM docs) GROUP BY term, {key}),
    freq AS (SELECT term, count(*) AS df FROM post GROUP BY term),
    wanted AS (SELECT {query_key}, term, count(*) AS qtf
               FROM (SELECT {query_key}, unnest({_terms(query_text)}) AS term FROM {queries}) GROUP BY {query_key}, term),
    scored AS (SELECT {query_key}, {key}, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5
                      / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
               FROM post JOIN freq USING (term) JOIN wanted USING (term), stats GROUP BY {query_key}, {key}),
    hits AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {query_key} ORDER BY score DESC, {key}) AS INTEGER) AS rank FROM scored)
             WHERE rank <= {k})"""


def _vector(table: str, key: str, text: str, prefix: str) -> str:
    return f"""
    {prefix}_slots AS (SELECT {key}, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 256 AS slot, count(*) AS n
                 FROM (SELECT {key}, unnest({_terms(text)}) AS term FROM {table}) GROUP BY ALL),
    {prefix}_vec AS (SELECT {key}, slot, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS w FROM {prefix}_slots)"""


_LEGS = (
    "WITH "
    + _bm25("documents", "doc_id", "text", 15)
    + ","
    + _vector("documents", "doc_id", "text", "d")
    + ","
    + _vector(_ASKED, "id", "question", "q")
    + """,
    near AS (SELECT id, doc_id, round(sum(q_vec.w * d_vec.w), 6) AS score FROM q_vec JOIN d_vec USING (slot) GROUP BY id, doc_id),
    vhits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, doc_id) AS rank FROM near) WHERE rank <= 15)"""
)

_ROWS = r"""
    l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no
          FROM documents WHERE text IS NOT NULL),
    r AS (SELECT doc_id, line_no, trim(line, ' ') AS row FROM l WHERE regexp_full_match(trim(line, ' '), '(?s)\|.*\|')
          AND regexp_matches(trim(line, ' '), '^\|.*\|$')),
    i AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM r),
    m AS (SELECT *, bool_or(regexp_matches(row, '^\|[\s\-:]+\|[\s\-:\|]*$')) OVER (PARTITION BY doc_id, island) AS sep FROM i),
    t AS (SELECT doc_id, line_no, row, dense_rank() OVER (PARTITION BY doc_id ORDER BY island) AS table_no,
                 [trim(c, ' ') for c in string_split(regexp_replace(row, '^\||\|$', '', 'g'), '|')] AS cells
          FROM m WHERE sep),
    body AS (SELECT * FROM t WHERE NOT regexp_matches(row, '^\|[\s\-:]+\|[\s\-:\|]*$'))"""

_QUALITY = (
    "WITH "
    + _ROWS
    + """,
    quality AS (SELECT doc_id, CAST(table_no AS INTEGER) AS table_no, count(*) AS n_rows, CAST(max(len(cells)) AS INTEGER) AS n_cols, count(*) - 1 AS data_rows,
           round(sum(len([c for c in cells if c = '']))::DOUBLE / sum(len(cells)), 6) AS empty_ratio,
           round(sum(len([c for c in cells if contains(c, '<br>')]))::DOUBLE / sum(len(cells)), 6) AS merged_ratio
    FROM body GROUP BY doc_id, table_no),
    reasoned AS (SELECT *, CASE WHEN n_cols < 3 THEN 'cols_too_few' WHEN empty_ratio > 0.5 THEN 'too_many_empty_cells'
                 WHEN data_rows < 2 THEN 'data_rows_too_few' ELSE 'kept' END AS reason FROM quality)"""
)

_STEM = r"regexp_replace(regexp_extract(replace({p}, '\', '/'), '([^/]*)$', 1), '^(.+)\.[^.]*$', '\1')"


def _stem(path: str) -> str:
    return _STEM.replace("{p}", path)


def _chunk_stem(chunk: str) -> str:
    return (
        rf"CASE WHEN regexp_matches({chunk}, '^(.*)::chunk::\d+$') THEN regexp_extract({chunk}, '^(.*)::chunk::\d+$', 1) "
        rf"WHEN regexp_matches({chunk}, '^(.*)_\d+$') THEN regexp_extract({chunk}, '^(.*)_\d+$', 1) ELSE {chunk} END"
    )


_NDCG = """least(1.0, coalesce(list_sum([1 / log2(i + 1) for i in range(1, len({kept}) + 1) if list_contains(e, {kept}[i])]), 0)
    / list_sum([1 / log2(i + 1) for i in range(1, least(len(e), 5) + 1)]))"""

_LONG = f"""
    res AS (SELECT * FROM {_R}),
    long AS (SELECT variant, question_id, 'retrieval_metrics' AS family, unnest(map_keys(retrieval_metrics)) AS metric, unnest(map_values(retrieval_metrics)) AS value FROM res
             UNION ALL
             SELECT variant, question_id, 'generation_metrics', unnest(map_keys(generation_metrics)), unnest(map_values(generation_metrics)) FROM res)"""

_MEANS = f"""WITH {_LONG},
    means AS (SELECT variant, family, metric, round(avg(value), 9) AS mean_value, count(value) AS n_values FROM long GROUP BY ALL),
    won AS (SELECT family, metric, variant, mean_value FROM (SELECT *, row_number() OVER (PARTITION BY family, metric ORDER BY
            CASE WHEN metric IN ('false_positive_rate', 'hallucination_rate', 'time_seconds') THEN mean_value ELSE -mean_value END, variant) AS k
            FROM means WHERE mean_value IS NOT NULL) WHERE k = 1)"""

_FILES = f"""files AS (SELECT replace(source_path, '\\', '/') AS path, sha256(content) AS sha, {_number('load_id')} % 3 AS snapshot, load_id FROM {_L})"""

_PAIRS = f"""pairs AS (SELECT r.result_id, r.question, r.answer, r.contexts, q.answer AS truth FROM {_R} r JOIN {_Q} q ON q.id = r.question_id)"""


def _jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN 1.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"


_OVERLAP = """offered AS (SELECT path, sha, 0 AS snapshot, load_id FROM files WHERE snapshot <= 1 UNION ALL SELECT path, sha256(sha), 1, load_id FROM files WHERE snapshot >= 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY snapshot, load_id) AS k FROM offered)"""


def oracle_sql() -> dict[str, str]:
    """Name -> SQL with the columns of the query of that name."""
    stem_files, stem_chunks = f"[{_stem('p')} for p in source_files]", "[" + _stem(f"({_chunk_stem('c')})") + " for c in source_chunks]"
    metrics = f"SELECT id, {stem_chunks} AS g, {stem_files} AS e FROM {_Q}"
    hit5 = "CAST(len(list_intersect(g[1:5], e)) > 0 AS DOUBLE)"
    sql = {
        "bm25_search": f"WITH {_bm25('documents', 'doc_id', 'text', 5)} SELECT id, doc_id, score, rank FROM hits",
        "bm25_terms": f"""WITH docs AS (SELECT doc_id, {_terms('text')} AS terms FROM documents), stats AS (SELECT count(*) AS n FROM docs)
            SELECT term, count(*) AS df, round(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1), 6) AS idf
            FROM (SELECT DISTINCT doc_id, unnest(terms) AS term FROM docs), stats GROUP BY term""",
        "vector_search": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
            s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_inner_product(q.e, v.e) / (q.n * v.n), 6) AS score FROM v q, v WHERE q.vec_id % 20 = 0)
            SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= 10""",
        "vector_search_euclid": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
            s AS (SELECT q.vec_id AS query_id, v.vec_id, CASE WHEN q.vec_id = v.vec_id THEN 0.0 ELSE round(-list_distance(q.e, v.e), 6) END AS score FROM v q, v WHERE q.vec_id % 20 = 0)
            SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= 5""",
        "hybrid_rrf": _LEGS + """, legs AS (SELECT id, doc_id, rank, 0 AS leg FROM vhits UNION ALL SELECT id, doc_id, rank, 1 FROM hits),
            fused AS (SELECT id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, min(leg * 1000 + rank) AS seen FROM legs GROUP BY id, doc_id)
            SELECT id, doc_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, seen, doc_id) AS INTEGER) AS rank FROM fused) WHERE rank <= 5""",
        "hybrid_weighted": _LEGS + """,
            a AS (SELECT id, doc_id, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-9 THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM vhits WINDOW w AS (PARTITION BY id)),
            b AS (SELECT id, doc_id, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-9 THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM hits WINDOW w AS (PARTITION BY id)),
            f AS (SELECT id, doc_id, round(0.7 * coalesce(a.s, 0) + 0.3 * coalesce(b.s, 0), 6) AS score FROM a FULL JOIN b USING (id, doc_id))
            SELECT id, doc_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM f) WHERE rank <= 5""",
        "rerank_hits": f"""WITH {_bm25('documents', 'doc_id', 'text', 10)},
            x AS (SELECT h.id, h.doc_id, h.rank, {_bare('q.question')} AS a, {_bare('d.text')} AS b FROM hits h JOIN documents d USING (doc_id) JOIN {_ASKED} q USING (id)),
            y AS (SELECT id, doc_id, rank, {_pairs_of('a')} AS p, {_pairs_of('b')} AS r FROM x),
            z AS (SELECT id, doc_id, rank, round({_jaccard('p', 'r')}, 6) AS rerank_score FROM y)
            SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY rerank_score DESC, rank, doc_id) AS INTEGER) AS rerank FROM z) WHERE rerank <= 3""",
        "multi_query_merge": "WITH subs AS (SELECT id || '#0' AS sub_id, id, 0 AS sub_no, question AS query FROM " + _ASKED + " UNION ALL SELECT id || '#1', id, 1, array_to_string(expected_keywords, ' ') FROM " + _ASKED + "),"
            + _bm25("documents", "doc_id", "text", 5, "subs", "sub_id", "query") + """,
            once AS (SELECT id, doc_id, score FROM (SELECT s.id, doc_id, score, row_number() OVER (PARTITION BY s.id, doc_id ORDER BY sub_no, rank) AS k FROM hits JOIN subs s USING (sub_id)) WHERE k = 1)
            SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM once) WHERE rank <= 5""",
        "context_budget": f"""WITH {_bm25('documents', 'doc_id', 'text', 10)},
            x AS (SELECT id, doc_id, rank, greatest(1, CAST(floor(length(text) / 4) AS BIGINT)) AS tokens FROM hits JOIN documents USING (doc_id)),
            y AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_tokens FROM x)
            SELECT * FROM y WHERE running_tokens <= 1500""",
        "search_quality": f"""WITH {_bm25(_L, 'load_id', 'content', 10)},
            lists AS (SELECT id, list({_stem('source_path')} ORDER BY rank) AS g FROM hits JOIN {_L} USING (load_id) GROUP BY id),
            x AS (SELECT a.id, coalesce(g, []) AS g, [{_stem('p')} for p in coalesce(a.expected_sources, [])] AS e FROM {_ASKED} a LEFT JOIN lists USING (id))
            SELECT id, {hit5} AS hit_rate,
                CASE WHEN len(e) = 0 THEN 0.0 ELSE round(len(list_intersect(g[1:5], list_distinct(e)))::DOUBLE / len(list_distinct(e)), 6) END AS recall,
                round(coalesce(1.0 / list_min([i for i in range(1, len(g) + 1) if list_contains(e, g[i])]), 0), 6) AS mrr,
                CASE WHEN len(e) = 0 THEN 0.0 ELSE round({_NDCG.format(kept='g[1:5]')}, 6) END AS ndcg,
                CASE WHEN len(g) = 0 THEN 0.0 ELSE round(len(list_distinct(g[1:5]))::DOUBLE / len(g[1:5]), 6) END AS diversity FROM x""",
        "fixed_chunks": r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '^[ \t\n\v\f\r]+|[^ \t\n\v\f\r]+[ \t\n\v\f\r]*') AS k FROM documents WHERE length(trim(text, ' ')) > 0),
            w AS (SELECT doc_id, k, unnest(range(0, 1 + CAST(ceil(greatest(0, len(k) - 64) / 48.0) AS BIGINT))) AS n FROM t WHERE len(k) > 0)
            SELECT doc_id || '::chunk::' || printf('%03d', n) AS chunk_id, doc_id, CAST(n AS INTEGER) AS chunk_index, CAST(n * 48 AS INTEGER) AS start_token,
                CAST(least(n * 48 + 64, len(k)) AS INTEGER) AS end_token, array_to_string(k[n * 48 + 1 : n * 48 + 64], '') AS text,
                CAST(length(array_to_string(k[n * 48 + 1 : n * 48 + 64], '')) AS INTEGER) AS char_count, CAST(least(n * 48 + 64, len(k)) - n * 48 AS INTEGER) AS token_count FROM w""",
        "page_chunks": r"""WITH p AS (SELECT load_id, unnest(string_split(content, chr(10) || chr(10))) AS text, generate_subscripts(string_split(content, chr(10) || chr(10)), 1) AS page_number
                  FROM """ + _L + r""" WHERE content IS NOT NULL),
            f AS (SELECT load_id, page_number, regexp_extract_all(text, '^[ \t\n\v\f\r]+|[^ \t\n\v\f\r]+[ \t\n\v\f\r]*') AS own FROM p WHERE length(regexp_replace(text, '\s', '', 'g')) > 0),
            g AS (SELECT *, lag(own) OVER w AS before, lag(page_number) OVER w AS from_page FROM f WINDOW w AS (PARTITION BY load_id ORDER BY page_number)),
            h AS (SELECT *, CASE WHEN before IS NULL THEN [] ELSE list_concat(before[greatest(len(before) - 5, 1) : len(before) - 1], [before[len(before)] || chr(10)]) END AS pre FROM g),
            j AS (SELECT load_id, page_number, from_page, len(pre) AS n_pre, list_concat(pre, own) AS k FROM h),
            w AS (SELECT *, unnest(range(0, 1 + CAST(ceil(greatest(0, len(k) - 24) / 20.0) AS BIGINT))) AS n FROM j)
            SELECT load_id || '_p' || page_number || '_' || printf('%03d', n) AS chunk_id, load_id, CAST(page_number AS INTEGER) AS page_number, CAST(n AS INTEGER) AS chunk_index, CAST(n * 20 AS INTEGER) AS start_token,
                CAST(least(n * 20 + 24, len(k)) AS INTEGER) AS end_token, array_to_string(k[n * 20 + 1 : n * 20 + 24], '') AS text, n * 20 < n_pre AS cross_page,
                CAST(CASE WHEN n * 20 < n_pre THEN from_page END AS INTEGER) AS overlap_from_page FROM w""",
        "text_units": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
            SELECT doc_id, CAST(len([s for s in string_split(regexp_replace(t, '([。！？；.!?;])', '\1' || chr(1), 'g'), chr(1)) if length(trim(s, ' ')) > 0]) AS INTEGER) AS n_sentences,
                CAST(len([s for s in string_split(regexp_replace(regexp_replace(t, '\n\s*\n', chr(1), 'g'), '\n#', chr(1) || '#', 'g'), chr(1)) if regexp_replace(s, '\s', '', 'g') <> '']) AS INTEGER) AS n_paragraphs,
                CAST(len([s for s in string_split(t, chr(10)) if regexp_matches(s, '^\s*#')]) AS INTEGER) AS n_headings FROM d""",
        "heading_list": r"""WITH l AS (SELECT doc_id, [regexp_replace(s, '^\s+|\s+$', '', 'g') for s in string_split(text, chr(10)) if regexp_matches(s, '^\s*#')] AS h FROM documents WHERE text IS NOT NULL)
            SELECT doc_id, CAST(generate_subscripts(h, 1) AS INTEGER) AS heading_no, unnest(h) AS heading FROM l""",
        "page_metrics": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS s FROM documents)
            SELECT doc_id, CAST(length(t) AS INTEGER) AS n_chars, CAST(CASE WHEN s = '' THEN 0 ELSE len(string_split_regex(s, '\s+')) END AS INTEGER) AS n_words,
                CAST(len([x for x in string_split(t, chr(10)) if regexp_matches(x, '^#[ #]')]) AS INTEGER) AS n_headings,
                CAST(len([x for x in string_split(t, chr(10)) if regexp_matches(trim(x, ' '), '^\|.*\|$')]) AS INTEGER) AS n_table_rows, s <> '' AS valid FROM d""",
        "document_metrics": r"""WITH d AS (SELECT coalesce(source, '?') AS source, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS s FROM documents)
            SELECT source, count(*) AS pages, CAST(sum(length(t)) AS BIGINT) AS n_chars, CAST(sum(CASE WHEN s = '' THEN 0 ELSE len(string_split_regex(s, '\s+')) END) AS BIGINT) AS n_words,
                CAST(sum(len([x for x in string_split(t, chr(10)) if regexp_matches(x, '^#[ #]')])) AS BIGINT) AS n_headings,
                CAST(sum(len([x for x in string_split(t, chr(10)) if regexp_matches(trim(x, ' '), '^\|.*\|$')])) AS BIGINT) AS n_table_rows,
                round(avg(CASE WHEN s <> '' THEN 1.0 ELSE 0.0 END), 6) AS valid_ratio FROM d GROUP BY source""",
        "table_quality": _QUALITY + " SELECT * FROM reasoned",
        "table_reasons": _QUALITY + " SELECT reason, count(*) AS n FROM reasoned GROUP BY reason",
        "degenerate_tables": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL),
            r AS (SELECT *, regexp_matches(trim(line, ' '), '^\|.*\|$') AS is_row FROM l),
            i AS (SELECT *, n - sum(CASE WHEN is_row THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS island FROM r),
            b AS (SELECT *, bool_and(len([c for c in string_split(regexp_replace(trim(line, ' '), '^\||\|$', '', 'g'), '|') if NOT regexp_full_match(c, '[-:\s]*')]) = 0) OVER (PARTITION BY doc_id, island, is_row) AS bare FROM i)
            SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(x.cleaned, '') END AS cleaned FROM documents d
            LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS cleaned FROM b WHERE NOT (is_row AND bare) GROUP BY doc_id) x USING (doc_id)""",
        "table_records": "WITH " + _ROWS + """,
            h AS (SELECT *, first_value(cells) OVER w AS header, row_number() OVER w AS k FROM body WINDOW w AS (PARTITION BY doc_id, table_no ORDER BY line_no))
            SELECT doc_id, CAST(table_no AS INTEGER) AS table_no, CAST(line_no AS INTEGER) AS line_no,
                array_to_string([concat_ws('=', header[i], cells[i]) for i in range(1, len(header) + 1)], '; ') AS record FROM h WHERE k > 1""",
        "source_names": f"""SELECT load_id, regexp_extract(replace(source_path, '\\', '/'), '([^/]*)$', 1) AS file_name, {_stem('source_path')} AS stem,
            regexp_extract(replace(source_path, '\\', '/'), '([^/]+)/[^/]+$', 1) || '/' || {_stem('source_path')} AS parent_stem, 'set_01_a' AS safe_name,
            CASE WHEN contains(source_path, 'annual') THEN 'annual_report' WHEN contains(source_path, 'research') THEN 'research_report' ELSE 'unknown' END AS category,
            CASE WHEN length(coalesce(content, '')) > 20 THEN substr(content, 1, 20) || '...' ELSE coalesce(content, '') END AS preview FROM {_L}""",
        "amounts": rf"""WITH a AS (SELECT result_id, regexp_extract_all(answer, '\d+(?:\.\d+)?\s*(?:亿元|万元|亿|万|元|%|％|个百分点|个)') AS x FROM {_R})
            SELECT result_id, CAST(generate_subscripts(x, 1) AS INTEGER) AS amount_no, unnest(x) AS amount FROM a""",
        "retrieval_metrics": f"""WITH x AS ({metrics}) SELECT id, {hit5} AS hit_rate,
            """ + ", ".join(f"CASE WHEN len(e) = 0 THEN 0.0 ELSE round(len(list_intersect(g[1:{k}], list_distinct(e)))::DOUBLE / len(list_distinct(e)), 6) END AS recall_{k}" for k in (3, 5, 10)) + f""",
            round(coalesce(1.0 / list_min([i for i in range(1, len(g) + 1) if list_contains(e, g[i])]), 0), 6) AS mrr,
            CASE WHEN len(e) = 0 THEN 0.0 ELSE round({_NDCG.format(kept='list_filter(g[1:5], lambda v, n: list_position(g[1:5], v) = n)')}, 6) END AS ndcg,
            CASE WHEN len(g) = 0 THEN 0.0 ELSE round(len(list_distinct(g[1:5]))::DOUBLE / len(g[1:5]), 6) END AS diversity FROM x""",
        "dedup_metrics": f"""WITH x AS (SELECT id, list_filter(g, lambda v, n: list_position(g, v) = n) AS g, e FROM ({metrics})) SELECT id, {hit5} AS dedup_hit_rate,
            CASE WHEN len(e) = 0 THEN 0.0 ELSE round({_NDCG.format(kept='g[1:5]')}, 6) END AS dedup_ndcg FROM x""",
        "chunk_metrics": f"""WITH q AS (SELECT id, source_chunks AS e, list_reverse(source_chunks) AS r FROM {_Q}),
            s AS (SELECT id, e, [CASE WHEN i % 2 = 1 THEN ({_chunk_stem('r[i]')}) || '::chunk::' || lpad((regexp_extract(r[i], '(\\d+)$', 1)::INTEGER + 1)::VARCHAR, 3, '0') ELSE r[i] END for i in range(1, len(r) + 1)] AS g FROM q),
            w AS (SELECT id, e, [CASE WHEN list_contains(e, c) THEN 2 WHEN len([x for x in e if ({_chunk_stem('x')}) = ({_chunk_stem('c')})
                     AND abs(regexp_extract(x, '(\\d+)$', 1)::INTEGER - regexp_extract(c, '(\\d+)$', 1)::INTEGER) <= 1]) > 0 THEN 1 ELSE 0 END for c in g] AS rel FROM s)
            SELECT id, CAST(coalesce(list_max(rel[1:5]), 0) > 0 AS DOUBLE) AS chunk_hit, round(coalesce(1.0 / list_min([i for i in range(1, len(rel) + 1) if rel[i] > 0]), 0), 6) AS chunk_mrr,
            CASE WHEN len(e) = 0 THEN 0.0 ELSE round(least(1.0, coalesce(list_sum([(2.0 ** rel[i] - 1) / log2(i + 1) for i in range(1, least(len(rel), 5) + 1)]), 0)
                / list_sum([3.0 / log2(i + 1) for i in range(1, least(len(e), 5) + 1)])), 6) END AS chunk_ndcg FROM w""",
        "false_positives": f"""SELECT question_type, count(*) AS n, round(avg(least(len(coalesce(source_chunks, [])), 5) / 5.0), 6) AS false_positive_rate
            FROM {_Q} WHERE expect_retrieval = false GROUP BY question_type""",
        "variant_means": _MEANS + " SELECT * FROM means",
        "type_means": f"""WITH {_LONG}, j AS (SELECT l.*, q.question_type FROM long l JOIN {_Q} q ON q.id = l.question_id)
            SELECT variant, question_type, metric, round(avg(value), 9) AS mean_value, count(value) AS n_values, CAST(grouping(question_type) AS INTEGER) AS level
            FROM j GROUP BY GROUPING SETS ((variant, question_type, metric), (variant, metric))""",
        "category_means": f"""SELECT variant, coalesce(q.category, 'unknown') AS category, round(avg(coalesce(retrieval_metrics['hit_rate'], 0.0)), 9) AS mean_value, count(*) AS n_rows
            FROM {_R} r JOIN {_Q} q ON q.id = r.question_id GROUP BY ALL""",
        "best_variants": _MEANS + " SELECT * FROM won",
        "win_counts": _MEANS + " SELECT variant, count(*) AS wins FROM won GROUP BY variant",
        "hallucination_rate": f"""SELECT variant, round(count(*) FILTER (v < 0.5)::DOUBLE / nullif(count(v), 0), 6) AS hallucination_rate
            FROM (SELECT variant, generation_metrics['faithfulness'] AS v FROM {_R}) GROUP BY variant""",
        "answer_scores": f"""WITH {_PAIRS},
            b AS (SELECT result_id, {_bare('question')} AS q, {_bare('answer')} AS a, {_bare('truth')} AS t, {_bare("array_to_string(coalesce(contexts, []), '')")} AS j,
                         [regexp_replace(lower(c), '\\s', '', 'g') for c in coalesce(contexts, [])] AS c FROM pairs),
            s AS (SELECT result_id, {_pairs_of('q')} AS q, {_pairs_of('a')} AS a, {_pairs_of('t')} AS t, {_pairs_of('j')} AS j, [{_pairs_of('x')} for x in c] AS c FROM b),
            r AS (SELECT *, [i for i in range(1, len(c) + 1) if {_jaccard('c[i]', 't')} >= 0.1] AS places FROM s)
            SELECT result_id, round({_jaccard('a', 'q')}, 6) AS answer_relevancy, round({_jaccard('a', 't')}, 6) AS answer_truth_overlap, round({_jaccard('j', 'q')}, 6) AS context_relevance,
                CASE WHEN len(places) = 0 THEN 0.0 ELSE round(list_sum([i::DOUBLE / places[i] for i in range(1, len(places) + 1)]) / len(places), 6) END AS context_precision FROM r""",
        "context_recall": rf"""WITH {_PAIRS},
            u AS (SELECT result_id, contexts, CASE WHEN regexp_matches(coalesce(truth, ''), '\|\s*:?-{{2,}}')
                    THEN [s for s in [regexp_replace(x, '^\s+|\s+$', '', 'g') for x in string_split(truth, chr(10))] if s <> '' AND NOT regexp_matches(s, '^\|[\s\-:|]+\|$')]
                    ELSE [s for s in [regexp_replace(x, '^\s+|\s+$', '', 'g') for x in string_split_regex(coalesce(truth, ''), '[。！？.!?]')] if s <> ''] END AS units FROM pairs),
            h AS (SELECT result_id, units, [regexp_replace(c, '\s', '', 'g') for c in coalesce(contexts, [])] AS c FROM u)
            SELECT result_id, CASE WHEN len(units) = 0 THEN 0.0 ELSE round(len([x for x in units if len([y for y in c if contains(y, regexp_replace(x, '\s', '', 'g'))]) > 0])::DOUBLE / len(units), 6) END AS context_recall FROM h""",
        "error_counts": f"SELECT variant, count(*) AS n, count(error) AS errors, round(count(error) / count(*), 6) AS error_rate FROM {_R} GROUP BY variant",
        "token_totals": f"""SELECT variant, category, CAST(grouping(variant) * 2 + grouping(category) AS INTEGER) AS level, count(*) AS calls,
            """ + ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in ("input_tokens", "output_tokens", "system_prompt_tokens", "contexts_tokens", "query_tokens")) + f"""
            FROM (SELECT coalesce(variant_name, '__none__') AS variant, coalesce(category, '__none__') AS category, * EXCLUDE (category) FROM {_T}) GROUP BY ROLLUP (variant, category)""",
        "token_split": f"""WITH t AS (SELECT record_id, coalesce(output_tokens, 0) AS o, output_tokens, coalesce(system_prompt_tokens, 0) AS s, coalesce(contexts_tokens, 0) AS c, coalesce(query_tokens, 0) AS q FROM {_T}),
            x AS (SELECT *, CASE WHEN s + c + q > 0 THEN CAST(round_even(s * output_tokens / (s + c + q), 0) AS BIGINT) ELSE 0 END AS a,
                            CASE WHEN s + c + q > 0 THEN CAST(round_even(c * output_tokens / (s + c + q), 0) AS BIGINT) ELSE 0 END AS b FROM t)
            SELECT record_id, a AS system_prompt_tokens_scaled, b AS contexts_tokens_scaled, CASE WHEN a IS NULL THEN 0 ELSE greatest(o - a - b, 0) END AS query_tokens_scaled FROM x""",
        "time_stats": f"""SELECT variant, count(time_seconds) AS n, round(avg(time_seconds), 4) AS mean_value, round(stddev_pop(time_seconds), 4) AS std_value, round(quantile_cont(time_seconds, 0.5), 4) AS median_value,
            round(quantile_disc(time_seconds, 0.95), 4) AS p95_value, round(min(time_seconds), 4) AS min_value, round(max(time_seconds), 4) AS max_value FROM {_R} WHERE time_seconds IS NOT NULL GROUP BY variant""",
        "stage_profile": """WITH s AS (SELECT event_type, sum(value) AS total, count(*) AS calls, max(value) AS peak FROM events GROUP BY event_type)
            SELECT event_type, round(total, 4) AS total_seconds, calls, round(total / calls, 6) AS mean_seconds, round(peak, 4) AS peak_seconds, round(total / sum(total) OVER (), 6) AS share,
                row_number() OVER (ORDER BY total DESC, event_type) = 1 AS bottleneck, total > 0.3 * sum(total) OVER () AS suggested, round(total / 100, 6) AS seconds_a_unit FROM s""",
        "day_numbers": f"""SELECT result_id, 'er_' || strftime(finished_at, '%Y%m%d') || '_' || printf('%03d', k) AS day_id
            FROM (SELECT result_id, finished_at, row_number() OVER (PARTITION BY finished_at::DATE ORDER BY finished_at, result_id) AS k FROM {_R})""",
        "token_windows": f"""SELECT date_trunc('day', ts) AS window_start, coalesce(category, '__none__') AS category, count(*) AS calls, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens,
            CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens FROM {_T} GROUP BY ALL""",
        "event_windows": """SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value, max(value) AS peak_value FROM events GROUP BY ALL""",
        "event_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
            s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
            SELECT min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, user_id, count(*) AS n FROM s GROUP BY user_id, k""",
        "question_filter": f"""SELECT id, test_set, question_type, category FROM {_Q} WHERE question_type IN ('single_fact', 'reasoning') AND category IN ('comparison', 'summary')
            AND metadata.review_status IN ('approved', 'auto_approved')""",
        "merged_testset": f"""WITH k AS (SELECT * FROM {_Q} WHERE metadata.review_status IS DISTINCT FROM 'rejected'),
            f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(question, chr(1) || id) ORDER BY test_set, id) AS n FROM k) WHERE n = 1)
            SELECT id, test_set, question, 'q' || printf('%03d', m) AS new_id FROM (SELECT *, row_number() OVER (PARTITION BY test_set ORDER BY id) AS m FROM f)""",
        "unknown_sources": f"""WITH w AS (SELECT DISTINCT id, unnest(source_files) AS p FROM {_Q}),
            a AS (SELECT id, count(*) AS missing FROM w WHERE p NOT IN (SELECT source_path FROM loaded_documents WHERE source_path IS NOT NULL) GROUP BY id)
            SELECT q.id, coalesce(missing, 0) AS missing FROM {_Q} q LEFT JOIN a USING (id)""",
        "testset_audit": f"""WITH h AS (SELECT test_set, source_path, count(*) AS n FROM (SELECT test_set, unnest(source_files) AS source_path FROM {_Q}) GROUP BY ALL)
            SELECT *, round(n / sum(n) OVER (PARTITION BY test_set), 6) AS share, n / sum(n) OVER (PARTITION BY test_set) > 0.15 AS skewed FROM h""",
        "repeated_questions": f"""SELECT question, count(*) AS n FROM (SELECT question FROM {_Q} UNION ALL SELECT question FROM (SELECT DISTINCT ON (id) * FROM golden_qa))
            WHERE question IS NOT NULL GROUP BY question HAVING count(*) > 1""",
        "review_progress": f"""WITH c AS (SELECT test_set, count(*) AS n, count(*) FILTER (metadata.review_status IN ('approved', 'auto_approved')) AS approved,
                count(*) FILTER (metadata.review_status = 'rejected') AS rejected FROM {_Q} GROUP BY test_set)
            SELECT *, n - approved - rejected AS pending, CASE WHEN n - approved - rejected = 0 THEN 'reviewed' WHEN approved + rejected > 0 THEN 'in_review' ELSE 'draft' END AS quality_status FROM c""",
        "question_quota": f"""WITH w AS (SELECT test_set, question_type, count(*) AS weight FROM {_Q} GROUP BY ALL),
            e AS (SELECT *, weight * 50 / sum(weight) OVER (PARTITION BY test_set) AS exact FROM w),
            f AS (SELECT *, floor(exact) AS fl, row_number() OVER (PARTITION BY test_set ORDER BY round(exact - floor(exact), 9) DESC, question_type) AS k FROM e)
            SELECT test_set, question_type, CAST(fl + CASE WHEN k <= 50 - sum(fl) OVER (PARTITION BY test_set) THEN 1 ELSE 0 END AS BIGINT) AS allotted FROM f""",
        "round_robin": f"""WITH d AS (SELECT load_id, row_number() OVER (ORDER BY load_id) - 1 AS place, count(*) OVER () AS n FROM {_L} WHERE content IS NOT NULL),
            q AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS turn FROM {_Q})
            SELECT id, load_id FROM q JOIN d ON q.turn % d.n = d.place""",
        "hash_sample": f"SELECT test_set, id FROM (SELECT test_set, id, row_number() OVER (PARTITION BY test_set ORDER BY md5('0' || id), id) AS k FROM {_Q}) WHERE k <= 5",
        "page_budget": f"""WITH s AS (SELECT metadata.format AS format, load_id, CAST(coalesce(length(content), 0) AS INTEGER) AS n_chars FROM {_L} WHERE metadata.format IS NOT NULL),
            r AS (SELECT *, CAST(sum(n_chars) OVER (PARTITION BY format ORDER BY load_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM s) SELECT * FROM r WHERE running - n_chars < 50000""",
        "systematic_sample": f"""WITH p AS (SELECT test_set, id, row_number() OVER (PARTITION BY test_set ORDER BY id) - 1 AS place, count(*) OVER (PARTITION BY test_set) AS size FROM {_Q})
            SELECT test_set, id FROM p WHERE size <= 7 OR list_contains([CAST(floor(i * size / 7) AS BIGINT) for i in range(0, 7)], place)""",
        "excerpt_found": rf"""WITH x AS (SELECT q.id, regexp_replace(ground_truth_excerpt, '\s', '', 'g') AS a, regexp_replace(content, '\s', '', 'g') AS b FROM {_Q} q JOIN {_L} d
                ON replace(q.source_files[1], '\', '/') = replace(d.source_path, '\', '/') WHERE ground_truth_excerpt IS NOT NULL AND content IS NOT NULL)
            SELECT id, CASE WHEN length(a) = 0 THEN false ELSE contains(b, a) OR (length(a) >= 15 AND len([k for k in range(1, greatest(length(a) - 14, 1) + 1, 7) if contains(b, substr(a, k, 15))]) > 0) END AS found FROM x""",
        "snapshot_ids": f"WITH {_FILES} SELECT snapshot, sha256(string_agg(sha, '|' ORDER BY sha)) AS data_id, count(*) AS files FROM files WHERE sha IS NOT NULL GROUP BY snapshot",
        "snapshot_merge": f"WITH {_FILES}, {_OVERLAP} SELECT path, sha, snapshot, load_id FROM ranked WHERE k = 1",
        "merge_counts": f"WITH {_FILES}, {_OVERLAP} SELECT snapshot, count(*) AS offered, count(*) FILTER (k = 1) AS added, count(*) FILTER (k > 1) AS duplicates FROM ranked GROUP BY snapshot",
        "snapshot_extend": f"WITH {_FILES} SELECT path, snapshot, load_id FROM files WHERE snapshot <= 1",
        "snapshot_status": f"""WITH {_FILES},
            now AS (SELECT path, CASE WHEN {_number('load_id')} % 7 = 0 THEN 'changed' ELSE sha END AS cur FROM files WHERE {_number('load_id')} % 10 <> 0),
            c AS (SELECT snapshot, count(*) FILTER (cur IS NULL) AS n_missing, count(*) FILTER (cur <> sha) AS n_changed FROM files LEFT JOIN now USING (path) GROUP BY snapshot)
            SELECT snapshot, CASE WHEN n_missing = 0 AND n_changed = 0 THEN 'available' WHEN n_missing = 0 THEN 'changed' WHEN n_changed = 0 THEN 'missing' ELSE 'mixed' END AS status, n_missing, n_changed FROM c""",
        "unparsed_files": f"WITH {_FILES} SELECT path, sha FROM files f WHERE NOT EXISTS (SELECT 1 FROM files g WHERE g.snapshot = 1 AND g.path = f.path AND g.sha = f.sha)",
        "variant_plan": f"""WITH v AS (SELECT variant, count(*) AS n, count(error) AS errors FROM {_R} GROUP BY variant)
            SELECT variant, CASE WHEN errors % 3 <> 0 AND n % 2 = 0 THEN 'reuse' WHEN errors % 3 <> 0 THEN 'confirm' ELSE 'run' END AS action FROM v""",
        "fingerprint_differences": f"""WITH q AS (SELECT id, difficulty, category, {_number('id')} AS k FROM {_Q}), d AS (
                SELECT id, 'difficulty' AS field, difficulty AS old, CASE WHEN k % 5 = 0 THEN 'hard' ELSE difficulty END AS new FROM q
                UNION ALL SELECT id, 'category', category, CASE WHEN k % 7 = 0 THEN NULL ELSE category END FROM q)
            SELECT * FROM d WHERE old IS DISTINCT FROM new""",
        "newest_results": f"""SELECT result_id, variant, finished_at, place FROM (SELECT result_id, variant, finished_at,
            CAST(row_number() OVER (PARTITION BY variant ORDER BY finished_at DESC, result_id DESC) AS INTEGER) AS place FROM {_R}) WHERE place <= 10""",
        "contained_documents": r"""WITH b AS (SELECT min(load_id) AS id, bare, length(bare) AS n FROM (SELECT load_id, regexp_replace(content, '\s+', '', 'g') AS bare FROM loaded_documents WHERE content IS NOT NULL) WHERE bare <> '' GROUP BY bare)
            SELECT a.id AS inner, o.id AS outer FROM b a, b o WHERE a.id <> o.id AND a.n >= 100 AND (o.n > a.n OR (o.n = a.n AND a.id < o.id))
            AND contains(o.bare, substr(a.bare, 1, 500)) AND contains(o.bare, substr(a.bare, a.n // 2 + 1, 500)) AND contains(o.bare, right(a.bare, 500))""",
        "text_classes": r"""WITH h AS (SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS bare FROM documents WHERE text IS NOT NULL)
            SELECT member, class FROM (SELECT doc_id AS member, min(doc_id) OVER (PARTITION BY bare) AS class FROM h) WHERE member <> class""",
        "authenticity": f"""WITH q AS (SELECT id, [x for x in [{", ".join(f"CASE WHEN contains(question, '{p}') THEN 'phrase {p}' END" for p in _ACADEMIC)},
                {", ".join(f"CASE WHEN starts_with(question, '{p}') THEN 'opening {p}' END" for p in _STARTS)}, CASE WHEN length(question) > 100 THEN 'too long' END] if x IS NOT NULL] AS i FROM {_Q} WHERE question IS NOT NULL)
            SELECT id, array_to_string(i, '; ') AS issues, len(i) = 0 AS authentic FROM q""",
        "unit_errors": rf"""WITH t AS (SELECT id, [CAST(replace(x, ',', '') AS DOUBLE) for x in regexp_extract_all(answer, '([\d,.]+)\s*亿', 1) if try_cast(replace(x, ',', '') AS DOUBLE) IS NOT NULL] AS told,
                CAST(trunc(CAST(regexp_extract(answer, '(\d+\.\d+)亿', 1) AS DOUBLE) * CASE WHEN {_number('id')} % 3 = 0 THEN 10 ELSE 1 END * 100000000) AS BIGINT) / 1e8 AS e FROM {_Q} WHERE regexp_matches(answer, '\d+\.\d+亿')),
            u AS (SELECT id, unnest(told) AS a, e FROM t WHERE e > 1 AND length(CAST(CAST(e * 1e8 AS BIGINT) AS VARCHAR)) >= 8)
            SELECT id, a AS answer_value, round(e, 2) AS excerpt_value FROM u WHERE a BETWEEN e * 9.5 AND e * 10.5 OR a BETWEEN e * 0.05 AND e * 0.15""",
        "short_answers": f"""WITH a AS (SELECT result_id, answer, substr(answer, 1, 60) AS h FROM {_R} WHERE answer IS NOT NULL),
            b AS (SELECT *, length(h) - instr(reverse(h), '。') + 1 AS last, instr(reverse(h), '。') AS p FROM a)
            SELECT result_id, CASE WHEN length(answer) <= 60 THEN answer WHEN p > 0 AND last > 30 THEN substr(h, 1, last) ELSE h END AS short_answer FROM b""",
        "document_keywords": f"""WITH docs AS (SELECT doc_id, {_terms('text')} AS terms FROM documents), stats AS (SELECT count(*) AS n FROM docs),
            post AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM docs) GROUP BY ALL), freq AS (SELECT term, count(*) AS df FROM post GROUP BY term),
            w AS (SELECT doc_id, term, round(tf * ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS weight FROM post JOIN freq USING (term), stats)
            SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS INTEGER) AS rank FROM w) WHERE rank <= 5""",
        "length_stats": """SELECT doc_kind, count(*) AS n, min(t) AS least, max(t) AS most, round(avg(t), 4) AS mean_tokens, round(avg(CASE WHEN t > 512 THEN 1.0 ELSE 0.0 END), 6) AS share_over
            FROM (SELECT doc_kind, greatest(1, CAST(floor(length(text) / 4) AS BIGINT)) AS t FROM documents WHERE text IS NOT NULL) GROUP BY doc_kind""",
        "stratified_sample": f"""WITH s AS (SELECT coalesce(metadata.format, '?') AS format, load_id, CAST(coalesce(length(content), 0) AS INTEGER) AS n_chars FROM {_L}),
            t AS (SELECT *, CAST(ntile(3) OVER (PARTITION BY format ORDER BY n_chars, load_id) AS INTEGER) AS third FROM s)
            SELECT format, load_id, n_chars, third FROM (SELECT *, row_number() OVER (PARTITION BY format, third ORDER BY md5(load_id), load_id) AS k FROM t) WHERE k <= 4""",
        "testset_quality": f"""SELECT test_set, count(*) AS n, round(avg(CASE WHEN {" OR ".join([f"contains(question, '{p}')" for p in _ACADEMIC] + [f"starts_with(question, '{p}')" for p in _STARTS])} OR length(question) > 100 THEN 0.0 ELSE 1.0 END), 4) AS authenticity_rate,
            round(avg(CASE WHEN metadata.excerpt_verified THEN 1.0 ELSE 0.0 END), 4) AS excerpt_rate, round(avg(CASE WHEN answer IS NOT NULL THEN 1.0 ELSE 0.0 END), 4) AS answer_rate, count(DISTINCT question_type) AS question_types
            FROM {_Q} GROUP BY test_set""",
        "answer_positions": f"""WITH {_PAIRS} SELECT result_id, CASE WHEN least(length(answer), length(truth)) = 0 THEN 0.0 ELSE round(len([i for i in range(1, least(length(answer), length(truth)) + 1)
            if substr(answer, i, 1) = substr(truth, i, 1)])::DOUBLE / least(length(answer), length(truth)), 6) END AS overlap FROM pairs WHERE answer IS NOT NULL AND truth IS NOT NULL""",
        "equivalent_hits": rf"""WITH m AS (SELECT min(regexp_extract(replace(source_path, '\', '/'), '^(.*_\d{{4}})_', 1)) AS g, replace(source_path, '\', '/') AS p FROM {_L} GROUP BY 2),
            x AS (SELECT id, [replace(p, '\', '/') for p in source_files] AS f FROM {_Q}),
            n AS (SELECT id, [coalesce(list_extract(map_extract(d, p), 1), p) for p in f] AS e FROM x, (SELECT map(list(p), list(g)) AS d FROM m)),
            y AS (SELECT id, e, list_reverse(e) AS g FROM n)
            SELECT id, CAST(len(e) AS INTEGER) AS n_expected, CASE WHEN len(e) = 0 THEN 0.0 ELSE round({_NDCG.format(kept="list_filter(g[1:5], lambda v, n: list_position(g[1:5], v) = n)")}, 6) END AS ndcg,
                CAST(len(list_intersect(g[1:1], e)) > 0 AS DOUBLE) AS hit_1 FROM y""",
        "case_lookup": f"""WITH q AS (SELECT id, question FROM {_Q} WHERE question IS NOT NULL), c AS (SELECT id AS case_id, substr(question, 1, 3 + {_number('id')} % 28) AS preview FROM q)
            SELECT id, min(case_id) AS case_id FROM q JOIN c ON preview <> '' AND starts_with(question, preview) GROUP BY id""",
    }
    sql["chunk_neighbours"] = f"""WITH c AS ({sql["fixed_chunks"]})
        SELECT a.chunk_id, b.chunk_id AS neighbour_id FROM c a JOIN c b ON a.doc_id = b.doc_id AND abs(a.chunk_index - b.chunk_index) <= 1"""
    sql["better_tables"] = _QUALITY + """, p AS (SELECT a.doc_id, a.table_no, a.merged_ratio AS am, b.merged_ratio AS bm, a.empty_ratio AS ae, b.empty_ratio AS be, a.data_rows AS ad, b.data_rows AS bd
            FROM reasoned a JOIN reasoned b ON a.doc_id = b.doc_id AND b.table_no = a.table_no + 1)
        SELECT doc_id, table_no, CASE WHEN am > 0 AND bm = 0 THEN true WHEN bm > 0 AND am = 0 THEN false WHEN abs(ae - be) > 0.15 THEN be < ae
            WHEN ad > 0 AND bd > 0 AND abs(bd - ad)::DOUBLE / greatest(ad, bd) > 0.3 THEN bd > ad ELSE true END AS replaced FROM p"""
    n = _number("id")
    sql["root_causes"] = f"""WITH q AS (SELECT {n} AS n, id, coalesce(question, '') AS question, source_chunks AS truth, ground_truth_excerpt AS excerpt FROM {_Q}),
        t AS (SELECT *, list_concat(['other::chunk::00' || k for k in range(0, n % 6)], CASE WHEN n % 5 = 0 THEN [] ELSE coalesce(truth, []) END) AS got FROM q),
        r AS (SELECT *, list_min([i for i in range(1, len(got) + 1) if list_contains(truth, got[i])]) AS first_got,
                list_min([i for i in range(1, len(got) + 1) if n % 3 <> 0 AND list_contains(truth, got[len(got) + 1 - i])]) AS first_reranked FROM t),
        c AS (SELECT *, coalesce(first_reranked, first_got) AS rank, CASE WHEN n % 7 <> 0 THEN n % 4 END AS held_count FROM r),
        h AS (SELECT *, CASE WHEN held_count IS NULL THEN first_got IS NOT NULL ELSE coalesce(rank <= held_count, false) END AS in_context FROM c)
        SELECT id, CASE WHEN coalesce(len(truth), 0) = 0 THEN 'RC-1' WHEN first_got IS NULL AND n % 2 = 0 THEN 'RC-5' WHEN first_got IS NULL THEN 'RC-1'
            WHEN held_count IS NOT NULL AND list_has_any(got, truth) AND NOT in_context THEN 'RC-3' WHEN first_reranked > 3 THEN 'RC-2' WHEN first_reranked IS NULL AND first_got > 3 THEN 'RC-2'
            WHEN in_context AND n % 8 <> 0 AND excerpt <> '' THEN 'RC-0' WHEN in_context THEN 'RC-4' ELSE 'RC-2' END AS root_cause, CAST(rank AS INTEGER) AS rank FROM h"""
    sql["greedy_unique"] = f"""WITH RECURSIVE q AS (SELECT id, row_number() OVER (ORDER BY id) AS n, lower(trim(coalesce(question, ''), ' ')) AS t, coalesce(source_files, []) AS f FROM {_Q}),
        s AS (SELECT a.n AS n, b.n AS m, CASE WHEN length(a.t) < length(b.t) THEN a.t ELSE b.t END AS shorter, CASE WHEN length(a.t) < length(b.t) THEN b.t ELSE a.t END AS longer
              FROM q a JOIN q b ON b.n < a.n AND list_has_any(a.f, b.f) AND least(length(a.t), length(b.t)) >= 0.84 * greatest(length(a.t), length(b.t))),
        c AS (SELECT n, list(m) AS earlier FROM s WHERE shorter = longer OR length(longer) > 0 AND len([x for x in string_split(shorter, '') if contains(longer, x)])::DOUBLE / length(longer) >= 0.85 GROUP BY n),
        e AS (SELECT n, id, coalesce(earlier, []) AS earlier FROM q LEFT JOIN c USING (n)),
        fold AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS kept
                 UNION ALL SELECT e.n, CASE WHEN list_has_any(e.earlier, fold.kept) THEN fold.kept ELSE list_append(fold.kept, e.n) END FROM fold JOIN e ON e.n = fold.n + 1),
        k AS (SELECT kept FROM fold ORDER BY n DESC LIMIT 1)
        SELECT id, list_contains(kept, n) AS kept FROM q, k"""
    sql["capped_shares"] = f"""WITH RECURSIVE d AS (SELECT coalesce(metadata.format, '?') AS format, load_id, coalesce(strlen(content), 0) / 1024.0 AS kb FROM {_L}),
        s AS (SELECT *, kb / sum(kb) OVER (PARTITION BY format) * 40 AS raw, CASE WHEN kb >= 8 THEN 5 WHEN kb >= 3 THEN 3 ELSE 1 END AS cap FROM d),
        g AS (SELECT format, list(load_id ORDER BY kb DESC, load_id) AS ids, list(CAST(cap AS DOUBLE) ORDER BY kb DESC, load_id) AS cap,
                list(CAST(least(raw, cap) AS DOUBLE) ORDER BY kb DESC, load_id) AS share FROM s GROUP BY format HAVING sum(kb) > 0),
        u AS (SELECT *, [i for i in range(1, len(ids) + 1) if share[i] < cap[i]] AS room, 40 - list_sum(share) AS over FROM g),
        w AS (SELECT format, ids, cap, room, share, CAST(over AS DOUBLE) AS over, 0 AS turn FROM u
              UNION ALL
              SELECT format, ids, cap, room, CASE WHEN more > 0.01 THEN list_transform(share, lambda x, i: CASE WHEN i = k THEN x + more ELSE x END) ELSE share END, CASE WHEN more > 0.01 THEN over - more ELSE over END, turn + 1
              FROM (SELECT *, least(over, cap[k] - share[k], 1.0) AS more FROM (SELECT *, room[1 + turn % len(room)] AS k FROM w WHERE over > 0.01 AND len(room) > 0 AND turn <= 120))),
        l AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY format ORDER BY turn DESC) = 1),
        r AS (SELECT format, ids, list_transform(share, lambda x: CAST(round_even(x, 0) AS INTEGER)) AS n FROM l),
        m AS (SELECT format, ids, n, CAST(40 - list_sum(n) AS INTEGER) AS lacking FROM r)
        SELECT format, unnest(ids) AS load_id, unnest(list_transform(n, lambda x, i: CAST(greatest(x + sign(lacking) * (abs(lacking) // len(ids) + CASE WHEN i <= abs(lacking) % len(ids) THEN 1 ELSE 0 END), 0) AS INTEGER))) AS allotted FROM m"""
    sql["prompt_assembly"] = rf"""WITH {_bm25("documents", "doc_id", "text", 3)},
        b AS (SELECT id, rank, '参考资料 ' || rank || '（来源：' || coalesce(regexp_replace({_stem("source")}, '\.pages$', ''), '未知') || '）:' || chr(10) || coalesce(text, '') AS block
              FROM hits JOIN (SELECT doc_id, text, source FROM documents) USING (doc_id))
        SELECT id, string_agg(block, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || '用户问题：' || any_value(q.question) || chr(10) || chr(10) || '请基于参考资料回答上述问题：' AS prompt
        FROM b JOIN {_ASKED} q USING (id) GROUP BY id"""
    sql["chat_turns"] = f"""WITH t AS (SELECT variant || '-' || {_number("result_id")} // 40 AS conversation, result_id || 'a' AS turn, 'user' AS role, question AS text FROM {_R}
              UNION ALL SELECT variant || '-' || {_number("result_id")} // 40, result_id || 'b', 'assistant', answer FROM {_R}),
        k AS (SELECT * FROM t WHERE trim(coalesce(text, ''), ' ') <> ''),
        f AS (SELECT *, first_value(role) OVER (PARTITION BY conversation ORDER BY turn) AS opens FROM k),
        o AS (SELECT *, row_number() OVER (PARTITION BY conversation ORDER BY CASE WHEN opens <> 'user' AND role <> 'user' THEN 1 ELSE 0 END, turn) AS place FROM f),
        c AS (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conversation ORDER BY place) THEN 0 ELSE 1 END AS changed FROM o),
        n AS (SELECT *, sum(changed) OVER (PARTITION BY conversation ORDER BY place ROWS UNBOUNDED PRECEDING) AS turn_no FROM c)
        SELECT conversation, CAST(turn_no AS BIGINT) AS turn_no, role, string_agg(text, chr(10) ORDER BY turn) AS text FROM n GROUP BY ALL"""
    sql["truth_in_stages"] = f"""WITH {_bm25(_L, "load_id", "content", 20)},
        h AS (SELECT id, source_path, rank, score FROM hits JOIN {_L} USING (load_id)),
        s AS (SELECT id, 'retrieval' AS stage, source_path, rank, score FROM h UNION ALL SELECT id, 'rerank', source_path, rank, score FROM h WHERE rank <= 5),
        w AS (SELECT s.*, list_contains(a.expected_sources, source_path) AS wanted FROM s JOIN {_ASKED} a USING (id))
        SELECT id, stage, min(rank) FILTER (wanted) AS best_rank, arg_min(score, rank) FILTER (wanted) AS best_score, coalesce(bool_or(wanted), false) AS in_stage FROM w GROUP BY id, stage"""
    sql["primary_pool"] = f"""WITH c AS ({sql["contained_documents"]}) SELECT DISTINCT load_id, source_path FROM loaded_documents WHERE load_id NOT IN (SELECT "inner" FROM c)"""
    sql["equivalence_groups"] = rf"""WITH f AS (SELECT replace(source_path, '\', '/') AS path, {_number("load_id")} AS n FROM {_L}),
        p AS (SELECT path FROM f UNION ALL SELECT regexp_replace(path, '\.([^./]*)$', CASE n % 3 WHEN 0 THEN '_摘要' WHEN 1 THEN '_英文版_' ELSE '_修订版_' END || '.\1') FROM f WHERE n % 2 = 0),
        g AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) || '/' || regexp_replace({_stem("path")}, '(_摘要|摘要|_英文版_|_修订版_)$', '') AS group_key, path FROM p)
        SELECT group_key, array_to_string(list_sort(list_distinct(list(path))), '|') AS members FROM g GROUP BY group_key HAVING count(DISTINCT path) > 1"""
    sql["multi_hop_pairs"] = f"""WITH c AS ({sql["fixed_chunks"]}), k AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM c)
        SELECT a.chunk_id, b.chunk_id AS neighbour_id FROM k a JOIN k b ON a.doc_id = b.doc_id AND b.chunk_index - a.chunk_index BETWEEN 2 AND 4 WHERE a.n >= 3"""
    forms = [("亿元", "亿", 1e8), ("万元", "万", 1e4), ("元", "元", 1), ("%", "%", 1), ("％", "%", 1), ("个百分点", "百分点", 1), ("个", "个", 1), ("", "", 1)]
    numbers = lambda text: "list_concat(" + ", ".join(rf"list_transform(regexp_extract_all({text}, '(\d+[\d,]*\.?\d*)\s*{suffix}', 1), lambda x: {{'v': TRY_CAST(replace(x, ',', '') AS DOUBLE), 'u': '{unit}', 'b': TRY_CAST(replace(x, ',', '') AS DOUBLE) * {factor}, 's': x || '{unit}'}})" if suffix else rf"list_transform(regexp_extract_all({text}, '\d+[\d,]*\.?\d*'), lambda x: {{'v': TRY_CAST(replace(x, ',', '') AS DOUBLE), 'u': '', 'b': TRY_CAST(replace(x, ',', '') AS DOUBLE) * {factor}, 's': x}})" for suffix, unit, factor in forms) + ")"
    sql["unsupported_numbers"] = f"""WITH q AS (SELECT id, answer, ground_truth_excerpt AS e FROM {_Q} WHERE coalesce(answer, '') <> '' AND coalesce(ground_truth_excerpt, '') <> ''),
        x AS (SELECT id, unnest({numbers("answer")}) AS a, generate_subscripts({numbers("answer")}, 1) AS k, e FROM q),
        w AS (SELECT id, a, k, e FROM x WHERE a.v >= 10),
        t AS (SELECT w.id, w.k, w.a, bool_or(abs(w.a.b - n.b) / greatest(n.b, 1) < 0.01 OR abs(w.a.v - n.v) / greatest(n.v, 1) < 0.05
                OR (n.u = '元' AND ((w.a.u = '亿' AND abs(w.a.v - n.v / 1e8) < 0.01) OR (w.a.u = '万' AND abs(w.a.v - n.v / 1e4) < 0.01)))) AS found
              FROM w LEFT JOIN (SELECT id, unnest({numbers("e")}) AS n FROM q) y ON w.id = y.id GROUP BY w.id, w.k, w.a)
        SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY k) AS INTEGER) AS issue_no, a.s AS number FROM t WHERE NOT coalesce(found, false)"""
    sql["sign_contradictions"] = rf"""WITH t AS (SELECT id, coalesce(answer, '') || CASE WHEN {n} % 2 = 0 THEN '，为负 ' || {n} % 25 || '.5' ELSE '' END AS a,
                coalesce(ground_truth_excerpt, '') || CASE WHEN {n} % 3 = 0 THEN ' -' || {n} % 25 || '.5' ELSE '' END AS e FROM {_Q}),
        p AS (SELECT id, a, e, list_filter(list_transform(regexp_extract_all(a, '(-?\d+[\d,.]*\d*|-?\d+)'), lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE)), lambda x: x > 0) AS v FROM t)
        SELECT id, (contains(a, '负值') OR contains(a, '为负') OR contains(a, '负数')) AND
            (len(list_filter(v, lambda x: contains(e, '-' || x) OR contains(e, format('-{{:,.2f}}', x)))) > 0 OR len(list_filter(v, lambda x: x > 10)) > 0) AS contradicts FROM p"""
    sql["question_patterns"] = rf"""WITH p AS (SELECT test_set, regexp_replace(regexp_replace(regexp_replace(coalesce(question, ''), '[\x{{4e00}}-\x{{9fff}}]{{2,6}}(集团|股份|公司|银行|医药|时代|电器|水泥|味业|白药|茅台|老窖)?', 'X', 'g'),
            '\d{{4}}', 'YEAR', 'g'), '[\d,.]+%?', 'NUM', 'g') AS pattern FROM {_Q}) SELECT test_set, pattern, count(*) AS n FROM p GROUP BY ALL HAVING count(*) >= 3"""
    first_source = "coalesce(source_files[1], 'unknown')"
    sql["concentrated_questions"] = f"""SELECT test_set, {first_source} AS source_path, coalesce(question_type, 'unknown') AS question_type, count(*) AS n
        FROM {_Q} WHERE question_type IS DISTINCT FROM 'irrelevant' GROUP BY ALL HAVING count(*) > 2"""
    sql["shared_entities"] = f"""WITH e AS (SELECT expect_retrieval, id, {first_source} AS source_path, list_sort(list_filter([question_type, difficulty], lambda x: x IS NOT NULL)) AS entities FROM {_Q} WHERE question_type IS DISTINCT FROM 'irrelevant')
        SELECT expect_retrieval, source_path, array_to_string(entities, '|') AS entities, count(*) AS n, min(id) AS first_id FROM e WHERE len(entities) >= 2 GROUP BY ALL HAVING count(*) >= 2"""
    sql["difficulty_histogram"] = f"SELECT test_set, coalesce(difficulty, 'unknown') AS difficulty, count(*) AS n FROM {_Q} GROUP BY ALL"
    sql["common_sources"] = f"""WITH h AS (SELECT test_set, unnest(source_files) AS source_path FROM {_Q}), c AS (SELECT test_set, source_path, count(*) AS n FROM h GROUP BY ALL)
        SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY test_set ORDER BY n DESC, source_path) AS INTEGER) AS place FROM c) WHERE place <= 10"""
    sql["question_tiers"] = f"""WITH m AS (SELECT id, {n} AS n FROM {_Q}), s AS (SELECT id, n, (n % 5 + n // 5 % 5 + n // 25 % 5 + n // 125 % 5) / 4.0 + 1 AS score FROM m)
        SELECT id, CASE WHEN n % 50 = 0 THEN 'C' WHEN score >= 4 THEN 'A' WHEN score >= 3 THEN 'B' ELSE 'C' END AS tier FROM s"""
    metrics = f"""metrics AS (SELECT DISTINCT unnest(list_concat(coalesce(map_keys(retrieval_metrics), []), coalesce(map_keys(generation_metrics), []))) AS metric FROM {_R}),
        backends AS (SELECT * FROM (VALUES ('faithfulness', 'external', 2), ('faithfulness', 'builtin', 1), ('answer_relevancy', 'external', 1), ('hit_rate', 'builtin', 1), ('mrr', 'builtin', NULL)) v(metric, backend, priority))"""
    sql["metric_backends"] = f"WITH {metrics} SELECT metric, arg_min(backend, coalesce(priority, 99)) AS backend FROM metrics LEFT JOIN backends USING (metric) GROUP BY metric"
    sql["metric_columns"] = f"WITH {metrics} SELECT metric, backend, backend || '_' || metric AS \"column\" FROM metrics JOIN backends USING (metric)"
    blocks = r"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents WHERE text IS NOT NULL),
        b AS (SELECT *, k * 12.0 AS y0, k * 12.0 + 10 AS y1, doc_id % 2 = 0 AND k % 3 = 1 AS right_side, CASE WHEN k = 0 THEN 17.0 WHEN k % 7 = 0 THEN 12.5 ELSE 10.0 END AS size, k % 7 = 0 AS bold,
                regexp_replace(text, '^[ \t\n\v\f\r]+|[ \t\n\v\f\r]+$', '', 'g') AS bare FROM l WHERE trim(text, ' ') <> ''),
        z AS (SELECT *, (length(bare) < 80 AND (y0 < 80 OR y1 > 720)) OR regexp_matches(bare, '请务必阅读.{0,20}声明') OR regexp_matches(bare, '^\s*\d+\s*$') OR regexp_matches(bare, '^\s*\d+\s*/\s*\d+\s*$')
                OR regexp_matches(bare, '(?:内部资料|机密|仅供参考).{0,30}$') OR regexp_matches(bare, '^(?:www\.|http).+$') AS noise,
                CASE WHEN NOT bold THEN '' WHEN size > 16 THEN '#' WHEN size > 14 THEN '##' WHEN size > 12 THEN '###' WHEN size > 11 AND length(text) < 100 THEN '####' ELSE '' END AS mark FROM b)"""
    sql["noise_blocks"] = f"WITH {blocks} SELECT doc_id, count(*) AS blocks, count(*) FILTER (noise) AS noise FROM z GROUP BY doc_id"
    sql["page_columns"] = f"""WITH {blocks}, s AS (SELECT doc_id, count(*) FILTER (NOT right_side) AS a, count(*) FILTER (right_side) AS b FROM z GROUP BY doc_id)
        SELECT doc_id, CASE WHEN a > 2 AND b > 2 AND least(a, b)::DOUBLE / greatest(a, b) > 0.3 THEN 2 ELSE 1 END AS n_columns FROM s"""
    sql["block_headings"] = f"WITH {blocks} SELECT doc_id, CAST(k AS INTEGER) AS k, mark FROM z WHERE mark <> ''"
    sql["page_markdown"] = f"""WITH {blocks}, s AS (SELECT doc_id, count(*) FILTER (NOT right_side) AS a, count(*) FILTER (right_side) AS b FROM z WHERE NOT noise GROUP BY doc_id),
        o AS (SELECT z.*, CASE WHEN a > 2 AND b > 2 AND least(a, b)::DOUBLE / greatest(a, b) > 0.3 AND right_side THEN 1 ELSE 0 END AS side FROM z JOIN s USING (doc_id) WHERE NOT noise)
        SELECT doc_id, string_agg(CASE WHEN mark <> '' THEN mark || ' ' ELSE '' END || text, chr(10) || chr(10) ORDER BY side, y0) AS text FROM o GROUP BY doc_id"""
    sql["cells_markdown"] = r"""WITH r AS (SELECT doc_id, list_transform(string_split(text, chr(10))[1:8], lambda l: string_split(l, ' ')[1:5]) AS rows FROM documents WHERE text IS NOT NULL),
        w AS (SELECT doc_id, list_max(list_transform(rows, lambda r: len(r))) AS width, rows FROM r),
        p AS (SELECT doc_id, width, list_filter(list_transform(rows, lambda r: [trim(regexp_replace(coalesce(r[i], ''), '\s*\n\s*', ' ', 'g'), ' ') for i in range(1, width + 1)]),
                lambda r: len([c for c in r if c <> '']) > 0 AND (width < 4 OR len([c for c in r if c <> '']) * 2 > width)) AS rows FROM w)
        SELECT doc_id, CASE WHEN len(rows) = 0 THEN '' ELSE array_to_string(list_concat(['| ' || array_to_string(rows[1], ' | ') || ' |', '|' || repeat(' --- |', width)], [('| ' || array_to_string(x, ' | ') || ' |') for x in rows[2:]]), chr(10)) END AS markdown FROM p"""
    sql["issue_transitions"] = f"""WITH t AS (SELECT question_id, result_id, finished_at, CASE WHEN error IS NOT NULL THEN 'failed' WHEN answer IS NULL THEN 'open' ELSE 'done' END AS to_state FROM {_R}),
        m AS (SELECT result_id, lag(to_state) OVER (PARTITION BY question_id ORDER BY finished_at NULLS FIRST, result_id) AS from_state, to_state FROM t)
        SELECT from_state, to_state, result_id, (from_state, to_state) IN (('open', 'done'), ('open', 'failed'), ('failed', 'open'), ('failed', 'done')) AS allowed FROM m WHERE from_state IS NOT NULL"""
    once = "list_filter(g, lambda v, n: list_position(g, v) = n)"
    graded = rf"""q AS (SELECT id, question_type, coalesce(expect_retrieval, true) AS wants, coalesce(list_reverse(source_chunks), []) AS r, coalesce(source_chunks, []) AS ec, [{_stem("p")} for p in coalesce(source_files, [])] AS e FROM {_Q}),
        m AS (SELECT *, [CASE WHEN i % 2 = 1 THEN ({_chunk_stem("r[i]")}) || '::chunk::' || lpad((regexp_extract(r[i], '(\d+)$', 1)::INTEGER + 1)::VARCHAR, 3, '0') ELSE r[i] END for i in range(1, len(r) + 1)] AS c FROM q),
        w AS (SELECT *, [{_stem("(" + _chunk_stem("x") + ")")} for x in c] AS g, [CASE WHEN list_contains(ec, y) THEN 2 WHEN len([x for x in ec if ({_chunk_stem("x")}) = ({_chunk_stem("y")})
                AND abs(regexp_extract(x, '(\d+)$', 1)::INTEGER - regexp_extract(y, '(\d+)$', 1)::INTEGER) <= 1]) > 0 THEN 1 ELSE 0 END for y in c] AS rel FROM m),
        k AS (SELECT *, wants AND len(e) > 0 AS has_documents, wants AND len(c) > 0 AND len(ec) > 0 AS has_chunks FROM w),
        d AS (SELECT id, {hit5} AS hit_rate, round(coalesce(1.0 / list_min([i for i in range(1, len(g) + 1) if list_contains(e, g[i])]), 0), 6) AS mrr,
                CASE WHEN len(e) > 0 THEN round({_NDCG.format(kept="g[1:5]")}, 6) END AS ndcg FROM (SELECT id, {once} AS g, e FROM k)),
        v AS (SELECT id, question_type, wants, {", ".join(f"CASE WHEN has_documents THEN round(len(list_intersect(g[1:{x}], list_distinct(e)))::DOUBLE / len(list_distinct(e)), 6) END AS recall_{x}" for x in (3, 5, 10))},
                CASE WHEN has_documents THEN {hit5} END AS hit_rate, CASE WHEN has_documents THEN round(coalesce(1.0 / list_min([i for i in range(1, len(g) + 1) if list_contains(e, g[i])]), 0), 6) END AS mrr,
                CASE WHEN has_documents THEN round({_NDCG.format(kept="list_filter(g[1:5], lambda v, n: list_position(g[1:5], v) = n)")}, 6) END AS ndcg,
                CASE WHEN len(g) > 0 THEN round(len(list_distinct(g[1:5]))::DOUBLE / len(g[1:5]), 6) END AS retrieval_diversity,
                CASE WHEN has_chunks THEN CAST(coalesce(list_max(rel[1:5]), 0) > 0 AS DOUBLE) END AS chunk_hit_rate, CASE WHEN has_chunks THEN round(coalesce(1.0 / list_min([i for i in range(1, len(rel) + 1) if rel[i] > 0]), 0), 6) END AS chunk_mrr,
                CASE WHEN has_chunks THEN round(least(1.0, coalesce(list_sum([(2.0 ** rel[i] - 1) / log2(i + 1) for i in range(1, least(len(rel), 5) + 1)]), 0) / list_sum([3.0 / log2(i + 1) for i in range(1, least(len(ec), 5) + 1)])), 6) END AS chunk_ndcg,
                CASE WHEN has_documents THEN d.hit_rate END AS dedup_hit_rate, CASE WHEN has_documents THEN d.mrr END AS dedup_mrr, CASE WHEN has_documents THEN d.ndcg END AS dedup_ndcg,
                CASE WHEN NOT wants THEN round(least(len(g), 5) / 5.0, 6) END AS false_positive_rate FROM k JOIN d USING (id))"""
    shown = lambda **fields: "array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN '{k}=' || printf('%.4f', {c}) END" for k, c in fields.items()) + "], lambda x: x IS NOT NULL)), ';')"
    sql["applicable_metrics"] = f"""WITH {graded} SELECT id, {shown(**{x: x for x in ("hit_rate", "mrr", "ndcg", "recall_3", "recall_5", "recall_10", "retrieval_diversity")})} AS retrieval,
        {shown(**{x: f"chunk_{x}" for x in ("hit_rate", "mrr", "ndcg")})} AS chunk, {shown(**{x: f"dedup_{x}" for x in ("hit_rate", "mrr", "ndcg")})} AS dedup, false_positive_rate FROM v"""
    joined = f"j AS (SELECT r.variant, r.generation_metrics AS gen, v.* FROM {_R} r JOIN v ON v.id = r.question_id)"
    gen = lambda m: f"round(avg(gen['{m}']), 9) AS avg_{m}"
    sql["experiment_aggregate"] = f"""WITH {graded}, {joined} SELECT variant, count(*) AS total_questions, count(hit_rate) AS applicable_questions,
        {", ".join(f"coalesce(round(avg({m}) FILTER (hit_rate IS NOT NULL), 9), 0) AS avg_{m}" for m in ("hit_rate", "mrr", "ndcg"))},
        {", ".join(f"round(avg(coalesce({f}_{m}, 0)) FILTER ({f}_hit_rate IS NOT NULL), 9) AS avg_{f}_{m}" for f in ("chunk", "dedup") for m in ("hit_rate", "mrr", "ndcg"))},
        round(avg(false_positive_rate), 9) AS avg_false_positive_rate, count(false_positive_rate) AS irrelevant_questions, round(avg(retrieval_diversity) FILTER (hit_rate IS NOT NULL), 9) AS avg_diversity,
        {", ".join(gen(m) for m in ("faithfulness", "answer_relevancy", "context_precision", "context_recall"))},
        CASE WHEN count(gen['faithfulness']) > 0 THEN round((count(*) FILTER (gen['faithfulness'] < 0.5))::DOUBLE / count(gen['faithfulness']), 6) END AS hallucination_rate FROM j GROUP BY variant"""
    sql["aggregate_by_type"] = f"""WITH {graded}, {joined} SELECT variant, coalesce(question_type, 'unknown') AS question_type, count(*) AS n,
        {", ".join(f"round(avg({m}) FILTER (hit_rate IS NOT NULL), 9) AS avg_{m}" for m in ("hit_rate", "mrr", "ndcg", "retrieval_diversity"))}, {gen("faithfulness")}, {gen("answer_relevancy")} FROM j GROUP BY ALL"""
    sql["latest_results"] = f"""WITH q AS (SELECT id, {n} AS n, difficulty, category FROM {_Q}), o AS (SELECT * FROM q WHERE n % 3 <> 0),
        w AS (SELECT id, CASE WHEN n % 4 = 0 THEN 'hard' END AS difficulty, 'checked' AS category FROM q WHERE n % 2 = 0)
        SELECT coalesce(o.id, w.id) AS id, coalesce(w.difficulty, o.difficulty) AS difficulty, coalesce(w.category, o.category) AS category FROM o FULL JOIN w ON o.id = w.id"""
    sql["case_actions"] = f"""WITH q AS (SELECT id, {n} AS n, CASE WHEN {n} % 4 < 2 THEN 'bad' ELSE 'good' END AS kind FROM {_Q})
        SELECT id, CASE WHEN n % 3 = 0 THEN 'saved' WHEN CASE WHEN n % 5 = 0 THEN 'good' ELSE kind END = kind THEN 'duplicate' ELSE 'type_changed' END AS action FROM q"""
    sql["snapshot_statistics"] = rf"""WITH {_FILES}, d AS (SELECT replace(source_path, '\', '/') AS path, content FROM {_L} WHERE content IS NOT NULL),
        c AS (SELECT path, len(string_split(content, chr(10) || chr(10))) AS pages, CASE WHEN length(trim(content, ' ')) > 0 THEN len(regexp_extract_all(content, '^[ \t\n\v\f\r]+|[^ \t\n\v\f\r]+[ \t\n\v\f\r]*')) ELSE 0 END AS tokens FROM d)
        SELECT snapshot, count(*) AS files, CAST(coalesce(sum(pages), 0) AS BIGINT) AS pages, CAST(coalesce(sum(CAST(ceil(tokens / 64.0) AS BIGINT)), 0) AS BIGINT) AS chunks FROM files LEFT JOIN c USING (path) GROUP BY snapshot"""
    sql["compared_pipelines"] = _QUALITY + r""", own AS (SELECT doc_id, count(*) AS tables, avg(empty_ratio) AS empty_ratio FROM quality GROUP BY doc_id),
        d AS (SELECT doc_id, doc_kind, coalesce(text, '') AS x, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS s FROM documents),
        p AS (SELECT doc_kind, coalesce(tables, 0) AS tables, length(x) AS chars, CASE WHEN s = '' THEN 0 ELSE len(string_split_regex(s, '\s+')) END AS words,
                len([l for l in string_split(x, chr(10)) if regexp_matches(l, '^#[ #]')]) AS headings, coalesce(empty_ratio, 0) AS empty_ratio, CASE WHEN s <> '' THEN 1.0 ELSE 0.0 END AS valid FROM d LEFT JOIN own USING (doc_id))
        SELECT doc_kind, count(*) AS pdfs_tested, CAST(sum(tables) AS BIGINT) AS total_tables, CAST(sum(chars) AS BIGINT) AS total_chars, CAST(sum(words) AS BIGINT) AS total_words, CAST(sum(headings) AS BIGINT) AS total_headings,
            round(avg(chars / 1000.0), 3) AS avg_parse_seconds, round(avg(empty_ratio), 3) AS avg_empty_ratio, round(avg(valid), 3) AS avg_valid_ratio FROM p GROUP BY doc_kind"""
    sql["sample_share"] = f"""SELECT test_set, id FROM (SELECT test_set, id, row_number() OVER (PARTITION BY test_set ORDER BY md5('0' || id), id) AS k, count(*) OVER (PARTITION BY test_set) AS n FROM {_Q})
        WHERE k <= greatest(1, least(n, ceil(n * CAST(0.15 AS DOUBLE))))"""
    sql["first_questions"] = f"SELECT id, test_set FROM {_Q} ORDER BY id LIMIT 25"
    sql["chosen_segments"] = rf"""WITH d AS (SELECT replace(source_path, '\', '/') AS path, content FROM {_L} WHERE length(trim(content, ' ')) > 0),
        c AS (SELECT path, CAST(ceil(len(regexp_extract_all(content, '^[ \t\n\v\f\r]+|[^ \t\n\v\f\r]+[ \t\n\v\f\r]*')) / 64.0) AS BIGINT) AS n FROM d),
        q AS (SELECT id, replace(source_files[1], '\', '/') AS path, CASE question_type WHEN 'multi_hop' THEN 3 WHEN 'comparison' THEN 3 WHEN 'summary' THEN 2 WHEN 'reasoning' THEN 2 ELSE 1 END AS most FROM {_Q}),
        s AS (SELECT id, least(most, n) AS m, CAST('0x' || substr(md5('0' || id), 1, 8) AS BIGINT) % (n - least(most, n) + 1) AS start FROM q JOIN c USING (path) WHERE n > 0)
        SELECT id, CAST(unnest(range(start, start + m)) AS INTEGER) AS segment_index FROM s"""
    sql["listed_issues"] = f"""SELECT id, question_type AS kind, difficulty AS priority, {n} AS created_at FROM {_Q} WHERE metadata.review_status = 'approved' AND (test_set = 'set_full' OR category = 'set_full')"""
    sql["file_kinds"] = rf"""WITH f AS (SELECT load_id, replace(source_path, '\', '/') AS p, coalesce(name, '') AS name FROM {_L})
        SELECT load_id, CASE WHEN contains(lower(p), '年报') OR contains(lower(p), 'annual') THEN 'annual' WHEN contains(lower(p), '研报') OR contains(lower(p), 'research') THEN 'research' ELSE 'generic' END AS pdf_type,
            CASE WHEN starts_with(p, 'data/') THEN '/mnt/store/' || substr(p, 6) ELSE p END AS moved,
            substr(regexp_replace(regexp_replace(lower(regexp_replace(name, '[^A-Za-z0-9_ -]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40) AS slug,
            CASE WHEN ends_with(lower(name), '.pdf') THEN name ELSE name || '.pdf' END AS pdf_name FROM f"""
    m = _number("result_id")
    sql["judged_answers"] = f"""WITH r AS (SELECT result_id, {m} AS n FROM {_R}),
        v AS (SELECT result_id, n, [(n + k) % 2 for k in range(1, n % 5 + 2)] AS verdicts FROM r)
        SELECT result_id, round(CASE WHEN n % 11 = 0 THEN NULL WHEN n % 7 = 0 THEN 0.75 ELSE least(1.0, (n % 6 + CASE WHEN n % 3 <> 0 THEN n % 5 ELSE 3 END + 3) / 15.0) END, 6) AS relevancy,
            round(len(list_filter(verdicts, lambda x: x = 1))::DOUBLE / len(verdicts), 6) AS faithfulness FROM v"""
    return sql
