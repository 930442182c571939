"""DuckDB oracle SQL for every registered query.

Each query is plain SQL over the driver's parquet views, written the most
direct way (windows over whole documents, every pair materialised) so that it
checks the Spark plans independently.  Fragments are named CTEs composed per
query; doubles are rounded to 6 digits like the Spark side.
"""

from __future__ import annotations

from ..sources import literals as L

NL = "chr(10)"
STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
WORDS = r"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"
MODELS = "(VALUES (0, 'hash-64', 'hashing/md5-64', 64), (1, 'hash-256', 'hashing/md5-256', 256)) " \
         "AS m(model_order, model_name, model_id, dim)"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(_q(w) for w in words) + "]"


def _values(query_set, alias: str = "t") -> str:
    rows = ", ".join(f"({i}, {_q(q)}, {_list(kw)})" for i, (q, kw) in enumerate(query_set))
    return f"(VALUES {rows}) AS {alias}(query_idx, query, keywords)"


def strip(x: str) -> str:
    return STRIP.format(x=x)


def words(x: str) -> str:
    return WORDS.format(x=x)


def lines_of(table: str, key_cols: str, text: str = "text", row_key: str = "doc_id") -> str:
    """Non-blank stripped lines with 0-based ``line_no`` per row."""
    return f"""
      SELECT {key_cols}, line, CAST(row_number() OVER (PARTITION BY {row_key} ORDER BY i) - 1 AS BIGINT) AS line_no
      FROM (SELECT {key_cols}, {strip('part')} AS line, i
            FROM (SELECT {key_cols}, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS i
                  FROM (SELECT *, string_split(regexp_replace(coalesce({text}, ''), '\\r\\n?', {NL}, 'g'), {NL})
                               AS parts FROM {table})))
      WHERE length(line) > 0"""


# ---------------------------------------------------------------------------
# fragments: name -> SQL (dependencies listed)

FRAG: dict[str, tuple[str, list[str]]] = {}


def frag(name, deps=()):
    def deco(fn):
        FRAG[name] = (fn(), list(deps))
        return fn
    return deco


@frag("lines")
def _lines():
    return lines_of("documents", "doc_id")


@frag("hl", ["lines"])
def _hl():
    return "SELECT *, (length(line) < 50 AND NOT suffix(line, '.')) AS is_header FROM lines"


@frag("sl", ["hl"])
def _sl():
    return ("SELECT *, sum(CASE WHEN is_header THEN 1 ELSE 0 END) OVER "
            "(PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section_id FROM hl")


@frag("s_paras", ["sl"])
def _s_paras():
    return ("SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS BIGINT) "
            "AS para_idx, section_id, line_no, line AS text FROM sl WHERE section_id > 0 AND NOT is_header")


@frag("s_pieces", ["s_paras"])
def _s_pieces():
    return f"""
      SELECT doc_id, para_idx, k, {strip('piece')} AS s
      FROM (SELECT doc_id, para_idx, unnest(p) AS piece, unnest(range(0, len(p))) AS k
            FROM (SELECT doc_id, para_idx, regexp_split_to_array(text, '[.!?]') AS p FROM s_paras))"""


@frag("s_sents", ["s_pieces"])
def _s_sents():
    return ("SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY para_idx, k) - 1 AS BIGINT) "
            "AS sent_idx, para_idx, k, s || '.' AS text FROM s_pieces WHERE length(s) > 20")


@frag("s_topics", ["sl"])
def _s_topics():
    stop = _list(L.KEYWORD_STOP_WORDS)
    return f"""
      SELECT doc_id, section_id, {_q(L.TOPIC_QUERY_PREFIX)} || lower(line) || {_q(L.TOPIC_QUERY_SUFFIX)} AS query,
             list_filter({words('line')}, lambda w: length(w) > 3 AND NOT list_contains({stop}, w)) AS kw
      FROM sl WHERE is_header AND section_id <= 5"""


@frag("s_kept", ["s_topics"])
def _s_kept():
    return (f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section_id) - 1 AS BIGINT) "
            f"AS query_idx, query, list_concat(kw, {_list(L.EXTRA_KEYWORDS)}) AS keywords "
            f"FROM s_topics WHERE len(kw) > 0")


@frag("s_queries", ["s_kept"])
def _s_queries():
    return f"""
      SELECT CAST(k.doc_id AS VARCHAR) AS doc, k.query_idx, k.query, k.keywords
      FROM s_kept k JOIN (SELECT doc_id, count(*) AS n FROM s_kept GROUP BY doc_id) c USING (doc_id) WHERE c.n >= 3
      UNION ALL
      SELECT CAST(d.doc_id AS VARCHAR) AS doc, CAST(g.query_idx AS BIGINT), g.query, g.keywords
      FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM s_kept GROUP BY doc_id) c USING (doc_id)
           CROSS JOIN {_values(L.GENERIC_QUERIES, 'g')}
      WHERE coalesce(c.n, 0) < 3"""


# unit tables in the shared schema ------------------------------------------

@frag("u_strict_p", ["s_paras"])
def _u_strict_p():
    return ("SELECT CAST(doc_id AS VARCHAR) AS doc, CAST(section_id AS VARCHAR) AS section, "
            "para_idx AS major, CAST(0 AS BIGINT) AS minor, text FROM s_paras")


@frag("u_strict_s", ["s_sents"])
def _u_strict_s():
    return ("SELECT CAST(doc_id AS VARCHAR) AS doc, para_idx AS major, CAST(0 AS BIGINT) AS minor, "
            "sent_idx AS piece, text FROM s_sents")


@frag("u_source_p")
def _u_source_p():
    return f"""
      SELECT source AS doc, CAST(doc_id AS VARCHAR) AS section, doc_id AS major, line_no AS minor, line AS text
      FROM ({lines_of('documents', 'doc_id, source')})"""


def _sentence_units(src: str) -> str:
    return f"""
      SELECT doc, major, minor, piece, s || '.' AS text
      FROM (SELECT doc, major, minor, k AS piece, {strip('p')} AS s
            FROM (SELECT doc, major, minor, unnest(ps) AS p, unnest(range(0, len(ps))) AS k
                  FROM (SELECT doc, major, minor, regexp_split_to_array(text, '[.!?]') AS ps FROM {src})))
      WHERE length(s) > 20"""


@frag("u_source_s", ["u_source_p"])
def _u_source_s():
    return _sentence_units("u_source_p")


@frag("u_chat_p")
def _u_chat_p():
    txt = strip(f"regexp_replace(coalesce(text, ''), '\\r\\n?', {NL}, 'g')")
    return f"""
      SELECT CAST(conv_id AS VARCHAR) AS doc, role AS section, turn AS major, CAST(0 AS BIGINT) AS minor, t AS text
      FROM (SELECT conv_id, role, turn, {txt} AS t FROM conversations) WHERE length(t) > 0"""


@frag("u_chat_s", ["u_chat_p"])
def _u_chat_s():
    return _sentence_units("u_chat_p")


@frag("default_q")
def _default_q():
    return f"SELECT CAST(query_idx AS BIGINT) AS query_idx, query, keywords FROM {_values(L.DEFAULT_QUERIES)}"


def embed(src: str, text: str = "text") -> str:
    """Hashing vectors: ``v`` DOUBLE[] of counts, ``norm_sq``, ``nnz``."""
    buckets = f"list_transform({words(text)}, lambda t: (('0x' || substr(md5(t), 1, 7))::INTEGER) % m.dim)"
    return f"""
      SELECT *, list_dot_product(v, v) AS norm_sq
      FROM (SELECT *, list_transform(range(dim), lambda i: CAST(len(list_filter(b, lambda x: x = i)) AS DOUBLE)) AS v,
                   len(list_distinct(b)) AS nnz
            FROM (SELECT u.*, m.model_order, m.model_name, m.model_id, m.dim, {buckets} AS b
                  FROM {src} u CROSS JOIN {MODELS}))"""


for _c in ("source", "strict", "chat"):
    FRAG[f"v_{_c}_p"] = (embed(f"u_{_c}_p"), [f"u_{_c}_p"])
    FRAG[f"v_{_c}_s"] = (embed(f"u_{_c}_s"), [f"u_{_c}_s"])

FRAG["v_default_q"] = (embed("default_q", "query"), ["default_q"])
FRAG["v_strict_q"] = (embed("s_queries", "query"), ["s_queries"])


@frag("benchmark_q")
def _benchmark_q():
    stop = _list(L.KEYWORD_STOP_WORDS)
    return f"""
      SELECT CAST(item_id AS BIGINT) AS query_idx, text AS query,
             list_distinct(list_filter({words('text')}, lambda w: length(w) > 3 AND NOT list_contains({stop}, w)))
               AS keywords
      FROM benchmark"""


FRAG["v_benchmark_q"] = (embed("benchmark_q", "query"), ["benchmark_q"])


@frag("v_vectors")
def _v_vectors():
    return """
      SELECT 'embeddings' AS doc, CAST(label AS VARCHAR) AS section, vec_id AS major, CAST(0 AS BIGINT) AS minor,
             'given-vectors' AS model_name, 0 AS model_order, CAST(embedding AS DOUBLE[]) AS v,
             list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS norm_sq,
             CAST(NULL AS VARCHAR) AS text
      FROM embeddings"""


@frag("v_given_p")
def _v_given_p():
    return """
      SELECT d.source AS doc, CAST(e.label AS VARCHAR) AS section, d.doc_id AS major, CAST(0 AS BIGINT) AS minor,
             CAST(0 AS BIGINT) AS piece, 'given' AS model_name, CAST(e.embedding AS DOUBLE[]) AS v,
             list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS norm_sq, d.text
      FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id"""


@frag("v_given_q", ["benchmark_q"])
def _v_given_q():
    return """
      SELECT q.*, 'given' AS model_name, CAST(e.embedding AS DOUBLE[]) AS v,
             list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS norm_sq
      FROM benchmark_q q JOIN embeddings e ON e.vec_id = q.query_idx"""


COS = "CASE WHEN {a}.norm_sq > 0 AND {b}.norm_sq > 0 THEN list_dot_product({a}.v, {b}.v) / sqrt({a}.norm_sq * {b}.norm_sq) END"


def cos(a: str, b: str) -> str:
    return COS.format(a=a, b=b)


def metric_frags(c: str, vec: str, sents: str | None, queries: str | None, per_doc: bool):
    """Coherence, contrast and search CTEs for corpus ``c``."""
    f = {}
    f[f"{c}_adj"] = (f"""
      SELECT model_name, doc, major, minor, p_major AS prev_major, p_minor AS prev_minor,
             CASE WHEN norm_sq > 0 AND p_norm > 0 THEN list_dot_product(v, p_v) / sqrt(norm_sq * p_norm) END
               AS similarity
      FROM (SELECT *, lag(major) OVER w AS p_major, lag(minor) OVER w AS p_minor, lag(v) OVER w AS p_v,
                   lag(norm_sq) OVER w AS p_norm
            FROM {vec} WINDOW w AS (PARTITION BY model_name, doc ORDER BY major, minor))
      WHERE p_major IS NOT NULL""", [vec])
    f[f"{c}_coh"] = (f"""
      SELECT model_name, doc, count(*) AS n_adjacent_pairs, count(*) FILTER (WHERE similarity IS NULL) AS n_undefined,
             avg(similarity) AS avg_coherence, min(similarity) AS min_coherence, max(similarity) AS max_coherence,
             stddev_pop(similarity) AS coherence_std
      FROM {c}_adj GROUP BY model_name, doc""", [f"{c}_adj"])
    long_ = "length(text) > 50" if c not in ("vectors", "given") else "TRUE"
    f[f"{c}_sp"] = (f"SELECT * FROM {vec} WHERE {long_}", [vec])
    f[f"{c}_pairs"] = (f"""
      SELECT a.model_name, a.doc, a.section = b.section AS same,
             list_dot_product(a.v, b.v) / sqrt(a.norm_sq * b.norm_sq) AS sim
      FROM {c}_sp a JOIN {c}_sp b ON a.model_name = b.model_name AND a.doc = b.doc
           AND (a.major < b.major OR (a.major = b.major AND a.minor < b.minor))
      WHERE a.norm_sq > 0 AND b.norm_sq > 0""", [f"{c}_sp"])
    f[f"{c}_con"] = (f"""
      SELECT b.model_name, b.doc, b.n_units, b.n_zero_vectors,
             CAST(coalesce(s.nw, 0) AS DOUBLE) AS n_within_pairs, CAST(coalesce(s.nc, 0) AS DOUBLE) AS n_cross_pairs,
             coalesce(s.aw, 0.0) AS avg_within_section_similarity,
             coalesce(s.ac, 0.0) AS avg_cross_section_similarity,
             coalesce(s.aw, 0.0) - coalesce(s.ac, 0.0) AS section_boundary_contrast,
             coalesce(s.sw, 0.0) AS within_similarity_std, coalesce(s.sc, 0.0) AS cross_similarity_std
      FROM (SELECT model_name, doc, count(*) AS n_units, count(*) FILTER (WHERE norm_sq <= 0) AS n_zero_vectors
            FROM {c}_sp GROUP BY model_name, doc) b
      LEFT JOIN (SELECT model_name, doc,
                        count(*) FILTER (WHERE same) AS nw, count(*) FILTER (WHERE NOT same) AS nc,
                        avg(sim) FILTER (WHERE same) AS aw, avg(sim) FILTER (WHERE NOT same) AS ac,
                        stddev_pop(sim) FILTER (WHERE same) AS sw, stddev_pop(sim) FILTER (WHERE NOT same) AS sc
                 FROM {c}_pairs GROUP BY model_name, doc) s USING (model_name, doc)""", [f"{c}_pairs", f"{c}_sp"])
    if sents is None:
        return f
    qkeys = "s.model_name = q.model_name AND s.doc = q.doc" if per_doc else "s.model_name = q.model_name"
    f[f"{c}_sims"] = (f"""
      SELECT s.model_name, s.doc, q.query_idx, s.major, s.minor, s.piece, {cos('s', 'q')} AS similarity
      FROM {sents} s JOIN {queries} q ON {qkeys}""", [sents, queries])
    f[f"{c}_top"] = (f"""
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_name, doc, query_idx
                                                 ORDER BY similarity DESC NULLS LAST, major DESC, minor DESC,
                                                          piece DESC) AS rank FROM {c}_sims)
      WHERE rank <= 3""", [f"{c}_sims"])
    qj = "t.doc = q.doc AND t.query_idx = q.query_idx AND t.model_name = q.model_name" if per_doc else \
        "t.query_idx = q.query_idx AND t.model_name = q.model_name"
    f[f"{c}_hits"] = (f"""
      SELECT t.model_name, t.doc, t.query_idx, t.rank, t.major, t.minor, t.piece, t.similarity,
             len(list_filter(q.keywords, lambda k: contains(lower(s.text), lower(k)))) > 0 AS matched
      FROM {c}_top t JOIN {sents} s ON t.model_name = s.model_name AND t.doc = s.doc AND t.major = s.major
           AND t.minor = s.minor AND t.piece = s.piece
      JOIN {queries} q ON {qj}""", [f"{c}_top", sents, queries])
    dq = "d.model_name = q.model_name AND d.doc = q.doc" if per_doc else "d.model_name = q.model_name"
    f[f"{c}_qp"] = (f"""
      SELECT d.model_name, d.doc, q.query_idx, coalesce(h.m, 0) AS keyword_matches,
             CAST(len(q.keywords) AS BIGINT) AS n_keywords,
             CASE WHEN len(q.keywords) > 0 THEN least(1.0, coalesce(h.m, 0) / len(q.keywords)) END AS precision
      FROM (SELECT model_name, doc FROM {c}_coh) d JOIN {queries} q ON {dq}
      LEFT JOIN (SELECT model_name, doc, query_idx, sum(CASE WHEN matched THEN 1 ELSE 0 END) AS m
                 FROM {c}_hits GROUP BY ALL) h
        ON h.model_name = d.model_name AND h.doc = d.doc AND h.query_idx = q.query_idx""",
                    [f"{c}_coh", queries, f"{c}_hits"])
    f[f"{c}_sp_prec"] = (f"""
      SELECT model_name, doc, count(*) AS n_queries, avg(precision) AS semantic_search_precision,
             min(precision) AS min_precision, max(precision) AS max_precision,
             stddev_pop(precision) AS search_precision_std
      FROM {c}_qp GROUP BY model_name, doc""", [f"{c}_qp"])
    f[f"{c}_res"] = (f"""
      SELECT c.*, k.n_within_pairs, k.n_cross_pairs,
             coalesce(k.avg_within_section_similarity, 0.0) AS avg_within_section_similarity,
             coalesce(k.avg_cross_section_similarity, 0.0) AS avg_cross_section_similarity,
             coalesce(k.section_boundary_contrast, 0.0) AS section_boundary_contrast,
             coalesce(k.within_similarity_std, 0.0) AS within_similarity_std,
             coalesce(k.cross_similarity_std, 0.0) AS cross_similarity_std,
             coalesce(p.semantic_search_precision, 0.0) AS semantic_search_precision,
             coalesce(p.min_precision, 0.0) AS min_precision, coalesce(p.max_precision, 0.0) AS max_precision,
             coalesce(p.search_precision_std, 0.0) AS search_precision_std,
             c.avg_coherence * 0.3 + coalesce(k.section_boundary_contrast, 0.0) * 0.3
               + coalesce(p.semantic_search_precision, 0.0) * 0.4 AS overall_score,
             m.model_order, m.model_id
      FROM {c}_coh c LEFT JOIN {c}_con k USING (model_name, doc) LEFT JOIN {c}_sp_prec p USING (model_name, doc)
      JOIN {MODELS} ON m.model_name = c.model_name""", [f"{c}_coh", f"{c}_con", f"{c}_sp_prec"])
    return f


FRAG.update(metric_frags("source", "v_source_p", "v_source_s", "v_default_q", False))
FRAG.update(metric_frags("strict", "v_strict_p", "v_strict_s", "v_strict_q", True))
FRAG.update(metric_frags("chat", "v_chat_p", "v_chat_s", "v_default_q", False))
FRAG.update(metric_frags("vectors", "v_vectors", None, None, False))
@frag("chat_own_q")
def _chat_own_q():
    return f"""
      SELECT CAST(conv_id AS VARCHAR) AS doc, query_idx, query, keywords
      FROM (SELECT conv_id, CAST(row_number() OVER w - 1 AS BIGINT) AS query_idx, text AS query,
                   list_filter({words('text')}, lambda w: length(w) > 3 AND NOT list_contains(
                     {_list(L.KEYWORD_STOP_WORDS)}, w)) AS keywords,
                   row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n
            FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
      WHERE i < n"""


FRAG["v_chat_own_q"] = (embed("chat_own_q", "query"), ["chat_own_q"])
FRAG.update(metric_frags("own", "v_chat_p", "v_chat_s", "v_chat_own_q", True))
FRAG.update(metric_frags("given", "v_given_p", "v_given_p", "v_given_q", False))
FRAG.update(metric_frags("bench", "v_source_p", "v_source_s", "v_benchmark_q", False))


@frag("pairs", [])
def _pairs():
    sa, sb = f"list_distinct({words('a.text')})", f"list_distinct({words('b.text')})"
    return f"""
      SELECT a.conv_id, a.turn, a.text AS text1, b.text AS text2,
             CASE WHEN len({sa}) + len({sb}) - len(list_intersect({sa}, {sb})) > 0
                  THEN len(list_intersect({sa}, {sb})) / (len({sa}) + len({sb}) - len(list_intersect({sa}, {sb})))
             END AS human_score
      FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"""


FRAG["v_turns"] = (embed("(SELECT conv_id, turn, text FROM conversations)"), [])


@frag("pair_sims", ["pairs", "v_turns"])
def _pair_sims():
    return f"""
      SELECT a.model_name, p.conv_id, p.turn, p.human_score, {cos('a', 'b')} AS similarity,
             a.dim AS embedding_dimension, a.v[1] AS e1_0, a.v[2] AS e1_1, a.v[3] AS e1_2, a.v[4] AS e1_3,
             a.v[5] AS e1_4, b.v[1] AS e2_0, b.v[2] AS e2_1, b.v[3] AS e2_2, b.v[4] AS e2_3, b.v[5] AS e2_4
      FROM pairs p JOIN v_turns a ON a.conv_id = p.conv_id AND a.turn = p.turn
      JOIN v_turns b ON b.conv_id = p.conv_id AND b.turn = p.turn + 1 AND b.model_name = a.model_name"""


@frag("pair_ok", ["pair_sims"])
def _pair_ok():
    return "SELECT * FROM pair_sims WHERE similarity IS NOT NULL AND human_score IS NOT NULL"


@frag("pearson", ["pair_ok"])
def _pearson():
    return ("SELECT model_name, covar_pop(human_score, similarity) / "
            "nullif(stddev_pop(human_score) * stddev_pop(similarity), 0) AS pearson_correlation, "
            "count(*) AS n FROM pair_ok GROUP BY model_name")


@frag("spearman", ["pair_ok"])
def _spearman():
    return """
      SELECT model_name, covar_pop(rh, rs) / nullif(stddev_pop(rh) * stddev_pop(rs), 0) AS spearman_correlation,
             count(*) AS n
      FROM (SELECT model_name,
                   rank() OVER (PARTITION BY model_name ORDER BY human_score)
                     + (count(*) OVER (PARTITION BY model_name, human_score) - 1) / 2.0 AS rh,
                   rank() OVER (PARTITION BY model_name ORDER BY similarity)
                     + (count(*) OVER (PARTITION BY model_name, similarity) - 1) / 2.0 AS rs
            FROM pair_ok)
      GROUP BY model_name"""


def build(final: str, *needs: str) -> str:
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in FRAG[n][1]:
            visit(d)
        order.append(n)

    for n in needs:
        visit(n)
    ctes = ",\n".join(f"{n} AS ({FRAG[n][0]})" for n in order)
    return f"WITH {ctes}\n{final}" if ctes else final


def over_pages(sql: str) -> str:
    """A query over ``documents`` put to the text of ``pages``: a CTE takes the table's name."""
    html = "coalesce(html, '')"
    for element in ("script", "style"):
        html = f"regexp_replace({html}, '<{element}\\b.*?</{element}\\s*>', {NL}, 'gis')"
    pages = f"SELECT page_id AS doc_id, regexp_replace({html}, '<[^>]*>', {NL}, 'g') AS text FROM pages"
    return f"WITH documents AS ({pages}),\n" + sql.strip().removeprefix("WITH ")


def over_sources(sql: str) -> str:
    """A query over ``documents`` put to whole sources: the texts of a source, by ``doc_id``, are one document."""
    whole = f"SELECT source AS doc_id, string_agg(text, {NL} ORDER BY doc_id) AS text FROM documents GROUP BY source"
    return f"WITH documents AS ({whole}),\n" + sql.strip().removeprefix("WITH ")


def r6(col: str, alias: str | None = None) -> str:
    return f"round(CAST({col} AS DOUBLE), 6) AS {alias or col.split('.')[-1]}"


def fixed(x: str, digits: int) -> str:
    """Fixed digits by the exact value; exact halves, whose further digits are 5 and zeros, go away from zero."""
    size = f"abs({x})"
    half = f"regexp_full_match(printf('%.60f', {size}), '[0-9]+\\.[0-9]{{{{{digits}}}}}50*')"
    shown = f"CASE WHEN {half} THEN printf('%.{digits}f', {size} + {10.0 ** -digits / 4!r}) ELSE printf('%.{digits}f', {size}) END"
    return f"CASE WHEN {x} < 0 THEN '-' ELSE '' END || {shown}".replace("{{", "{").replace("}}", "}")


def oracle_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    coh_cols = ("model_name, doc, n_adjacent_pairs, n_undefined, " + ", ".join(
        r6(c) for c in ["avg_coherence", "min_coherence", "max_coherence", "coherence_std"]))
    con_cols = ("model_name, doc, n_units, n_zero_vectors, n_within_pairs, n_cross_pairs, " + ", ".join(
        r6(c) for c in ["avg_within_section_similarity", "avg_cross_section_similarity",
                        "section_boundary_contrast", "within_similarity_std", "cross_similarity_std"]))
    sp_cols = ("model_name, doc, n_queries, " + ", ".join(
        r6(c) for c in ["semantic_search_precision", "min_precision", "max_precision", "search_precision_std"]))

    q["doc_scan"] = build(f"""
      SELECT d.doc_id, d.source, d.lang,
             length(regexp_replace(d.text, '\\r\\n?', {NL}, 'g')) AS text_len, coalesce(l.n, 0) AS n_lines
      FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id) l USING (doc_id)""",
                          "lines")
    q["doc_lines"] = build("SELECT doc_id, line_no, line, is_header FROM hl", "hl")
    q["sections"] = build(f"""
      SELECT h.doc_id, CAST(h.section_id AS BIGINT) AS section_id, h.line AS header,
             count(b.text) AS n_body_lines,
             h.line || coalesce({NL} || string_agg(b.text, {NL} ORDER BY b.line_no), '') AS section_text
      FROM sl h LEFT JOIN s_paras b ON b.doc_id = h.doc_id AND b.section_id = h.section_id
      WHERE h.is_header GROUP BY h.doc_id, h.section_id, h.line""", "sl", "s_paras")
    q["paragraphs"] = build("SELECT doc_id, para_idx, CAST(section_id AS BIGINT) AS section_id, text FROM s_paras",
                            "s_paras")
    q["sentences"] = build("SELECT doc_id, sent_idx, para_idx, text FROM s_sents", "s_sents")
    q["section_paragraphs"] = build("""
      SELECT doc_id, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY section_id) - 1 AS BIGINT) AS section_idx,
             CAST(section_id AS BIGINT) AS section_id,
             CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS BIGINT) AS pos, text
      FROM s_paras WHERE length(text) > 50""", "s_paras")
    q["search_queries"] = build("SELECT doc, query_idx, query, array_to_string(keywords, '|') AS keywords "
                                "FROM s_queries", "s_queries")
    q["doc_stats"] = build("""
      SELECT d.doc_id, coalesce(s.n, 0) AS n_sections, coalesce(p.n, 0) AS n_paragraphs,
             coalesce(t.n, 0) AS n_sentences, coalesce(qq.n, 0) AS n_queries
      FROM documents d
      LEFT JOIN (SELECT doc_id, count(*) AS n FROM sl WHERE is_header GROUP BY doc_id) s USING (doc_id)
      LEFT JOIN (SELECT doc_id, count(*) AS n FROM s_paras GROUP BY doc_id) p USING (doc_id)
      LEFT JOIN (SELECT doc_id, count(*) AS n FROM s_sents GROUP BY doc_id) t USING (doc_id)
      LEFT JOIN (SELECT doc, count(*) AS n FROM s_queries GROUP BY doc) qq ON qq.doc = CAST(d.doc_id AS VARCHAR)""",
                           "sl", "s_paras", "s_sents", "s_queries")

    q["unit_embeddings"] = build(f"SELECT model_name, doc, major, minor, CAST(dim AS BIGINT) AS dim, "
                                 f"{r6('norm_sq')}, CAST(nnz AS BIGINT) AS nnz FROM v_source_p", "v_source_p")
    q["vector_preview"] = build("SELECT model_name, doc, major, minor, CAST(dim AS BIGINT) AS dim, "
                                + ", ".join(f"round(v[{i + 1}], 6) AS v{i}" for i in range(5))
                                + " FROM v_source_p", "v_source_p")

    q["cosine_scalar"] = build(f"""
      SELECT a.vec_id, {r6('list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / '
                          'sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * '
                          'list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))',
                          'cosine')}
      FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
    q["adjacent_similarity"] = build(f"SELECT model_name, doc, major, minor, prev_major, prev_minor, "
                                     f"{r6('similarity')} FROM source_adj", "source_adj")
    q["paragraph_coherence"] = build(f"SELECT {coh_cols} FROM source_coh", "source_coh")
    q["paragraph_coherence_vectors"] = build(f"SELECT {coh_cols} FROM vectors_coh", "vectors_coh")
    q["paragraph_coherence_chats"] = build(f"SELECT {coh_cols} FROM chat_coh", "chat_coh")
    q["paragraph_coherence_strict"] = build(f"SELECT {coh_cols} FROM strict_coh", "strict_coh")

    q["section_contrast"] = build(f"SELECT {con_cols} FROM source_con", "source_con")
    q["section_contrast_moments"] = q["section_contrast"]
    q["section_contrast_vectors"] = build(f"SELECT {con_cols} FROM vectors_con", "vectors_con")
    q["section_contrast_chats"] = build(f"SELECT {con_cols} FROM chat_con", "chat_con")
    q["paragraph_pairs"] = build(f"""
      SELECT model_name, doc, same AS same_section, CAST(count(*) AS DOUBLE) AS n_pairs, {r6('avg(sim)', 'avg_similarity')}
      FROM source_pairs GROUP BY model_name, doc, same""", "source_pairs")

    q["search_queries_default"] = build(f"""
      SELECT d.doc, CAST(q.query_idx AS BIGINT) AS query_idx, q.query, array_to_string(q.keywords, '|') AS keywords
      FROM (SELECT DISTINCT source AS doc FROM documents) d CROSS JOIN {_values(L.DEFAULT_QUERIES, 'q')}""")
    q["query_sentence_similarity"] = build(f"SELECT model_name, doc, query_idx, major, minor, piece, "
                                           f"{r6('similarity')} FROM source_sims", "source_sims")
    q["search_top3"] = build(f"SELECT model_name, doc, query_idx, major, minor, piece, {r6('similarity')}, "
                             f"CAST(rank AS BIGINT) AS rank FROM source_top", "source_top")
    q["keyword_hits"] = build(f"SELECT model_name, doc, query_idx, CAST(rank AS BIGINT) AS rank, major, minor, "
                              f"piece, {r6('similarity')}, matched FROM source_hits", "source_hits")
    q["query_precision"] = build(f"SELECT model_name, doc, query_idx, CAST(keyword_matches AS BIGINT) "
                                 f"AS keyword_matches, n_keywords, {r6('precision')} FROM source_qp", "source_qp")
    q["search_precision"] = build(f"SELECT {sp_cols} FROM source_sp_prec", "source_sp_prec")
    q["search_precision_topics"] = build(f"SELECT {sp_cols} FROM strict_sp_prec", "strict_sp_prec")
    q["search_precision_custom"] = build(f"SELECT {sp_cols} FROM bench_sp_prec", "bench_sp_prec")

    q["conversation_set_precision"] = build(f"SELECT {sp_cols} FROM own_sp_prec", "own_sp_prec")

    q["overall_score"] = build("SELECT model_name, doc, " + ", ".join(r6(c) for c in [
        "avg_coherence", "section_boundary_contrast", "semantic_search_precision", "overall_score"])
        + " FROM source_res", "source_res")
    q["leaderboard"] = build("""
      SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY overall_score DESC NULLS LAST, model_order)
                       AS BIGINT) AS position,
             model_name, round(overall_score, 4) AS overall_score,
             row_number() OVER (PARTITION BY doc ORDER BY overall_score DESC NULLS LAST, model_order) = 1 AS is_best
      FROM source_res""", "source_res")
    metrics = ["overall_score", "avg_coherence", "section_boundary_contrast", "semantic_search_precision"]
    q["best_per_metric"] = build(" UNION ALL ".join(
        f"SELECT doc, '{m}' AS metric, arg_max(model_name, (round({m}, 6), -model_order)) AS best_model, "
        f"round(max(round({m}, 6)), 6) AS best_value FROM source_res GROUP BY doc" for m in metrics), "source_res")
    q["model_count"] = build("SELECT doc, count(*) AS n_models FROM source_res GROUP BY doc", "source_res")
    q["results_merge"] = build(f"""
      SELECT model_name, doc, CAST(CASE WHEN model_name = 'hash-256' THEN 2 ELSE 1 END AS BIGINT) AS run_order,
             {r6('avg_coherence')} FROM source_coh""", "source_coh")
    q["results_json_rows"] = build("SELECT doc, model_name, model_id, " + ", ".join(r6(c) for c in [
        "avg_coherence", "section_boundary_contrast", "semantic_search_precision", "overall_score"])
        + " FROM source_res", "source_res")
    q["result_files"] = q["results_json_rows"]
    q["dashboard_table"] = build(f"""
      SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY overall_score DESC NULLS LAST, model_order)
                       AS BIGINT) AS position,
             model_name, """ + ", ".join(f"{fixed(c, 4)} AS {c}" for c in [
        "overall_score", "avg_coherence", "section_boundary_contrast", "semantic_search_precision"]) + f""",
             {fixed('greatest(section_boundary_contrast, -1)', 4)} AS shown_contrast
      FROM source_res""", "source_res")
    strict_docs = "(SELECT DISTINCT CAST(doc_id AS VARCHAR) AS doc FROM documents)"
    q["results_or_placeholder"] = build(f"""
      SELECT doc, model_name, model_id, {r6('avg_coherence')}, {r6('overall_score')} FROM strict_res
      UNION ALL
      SELECT d.doc, 'empty', 'none', 0.0, 0.0 FROM {strict_docs} d
      WHERE d.doc NOT IN (SELECT doc FROM strict_res)""", "strict_res")
    q["results_clean"] = over_pages(build(f"""
      SELECT doc, model_name, {r6('overall_score')} FROM strict_res
      UNION ALL
      SELECT d.doc, 'empty', 0.0 FROM {strict_docs} d WHERE d.doc NOT IN (SELECT doc FROM strict_res)""",
                                          "strict_res"))
    q["long_document_sections"] = over_sources(build("""
      SELECT h.doc_id, CAST(h.section_id AS BIGINT) AS section_id, h.line AS header, count(b.text) AS n_body_lines
      FROM sl h LEFT JOIN s_paras b ON b.doc_id = h.doc_id AND b.section_id = h.section_id
      WHERE h.is_header GROUP BY h.doc_id, h.section_id, h.line""", "sl", "s_paras"))
    q["long_document_paragraphs"] = over_sources(build("""
      SELECT doc_id, para_idx, CAST(section_id AS BIGINT) AS section_id, text,
             CASE WHEN l THEN CAST(dense_rank() OVER (PARTITION BY doc_id, l ORDER BY section_id) - 1 AS BIGINT) END
               AS section_idx,
             CASE WHEN l THEN CAST(row_number() OVER (PARTITION BY doc_id, l ORDER BY line_no) - 1 AS BIGINT) END AS pos
      FROM (SELECT *, length(text) > 50 AS l FROM s_paras)""", "s_paras"))
    q["long_document_sentences"] = over_sources(q["sentences"])
    q["long_document_score"] = over_sources(build("SELECT model_name, doc, " + ", ".join(r6(c) for c in [
        "avg_coherence", "section_boundary_contrast", "semantic_search_precision", "overall_score"])
        + " FROM strict_res", "strict_res"))
    q["page_search_queries"] = over_pages(q["search_queries"])
    q["page_search_precision"] = over_pages(q["search_precision_topics"])
    q["user_model_score"] = q["overall_score"]
    q["results_export"] = build("""
      SELECT doc, string_agg(model_name || ':' || printf('%.6f', overall_score), ',' ORDER BY model_name) AS results
      FROM source_res GROUP BY doc""", "source_res")
    q["latest_run"] = "SELECT max(CAST(doc_id AS VARCHAR)) AS last_document FROM documents"
    q["status_history"] = build(f"""
      SELECT d.doc AS document_name, CAST(p.phase AS BIGINT) AS phase,
             CASE WHEN p.phase = 0 THEN 'processing' WHEN coalesce(n.n, 0) > 0 THEN 'completed' ELSE 'error' END AS status,
             CAST(CASE WHEN p.phase = 1 AND coalesce(n.n, 0) > 0 THEN 100 ELSE 0 END AS BIGINT) AS progress,
             CAST(CASE WHEN p.phase = 1 THEN coalesce(n.n, 0) ELSE 0 END AS BIGINT) AS n_models
      FROM {strict_docs} d CROSS JOIN (VALUES (0), (1)) AS p(phase)
      LEFT JOIN (SELECT doc, count(*) AS n FROM strict_res GROUP BY doc) n USING (doc)""", "strict_res")
    q["failed_units"] = build("""
      SELECT 'broken' AS model_name, doc, count(*) AS n_failed, false AS evaluated,
             'RuntimeError: no such model: none' AS error
      FROM u_source_p GROUP BY doc
      UNION ALL SELECT model_name, doc, 0, true, NULL FROM source_coh WHERE model_name = 'hash-64'""",
                              "u_source_p", "source_coh")
    bad = "regexp_matches(text, '[0-9]')"
    q["failure_ledger"] = build(f"""
      SELECT 'no-digits' AS model_name, false AS every_doc, doc, unit_kind, count(*) AS n_failed,
             'ValueError: fails on digits' AS error, CAST(NULL AS DOUBLE) AS overall_score
      FROM (SELECT doc, text, 'paragraph' AS unit_kind FROM u_chat_p
            UNION ALL SELECT doc, text, 'sentence' FROM u_chat_s) WHERE {bad} GROUP BY doc, unit_kind
      UNION ALL
      SELECT 'no-questions', false, doc, unit_kind, count(*), 'ValueError: fails on questions', NULL
      FROM (SELECT doc, text, 'paragraph' AS unit_kind FROM u_chat_p
            UNION ALL SELECT doc, text, 'sentence' FROM u_chat_s) WHERE suffix(text, '?') GROUP BY doc, unit_kind
      UNION ALL
      SELECT 'no-questions', true, NULL, 'query', count(*), 'ValueError: fails on questions', NULL
      FROM default_q WHERE suffix(query, '?') HAVING count(*) > 0
      UNION ALL
      SELECT n.name, false, r.doc, NULL, 0, NULL, {r6('r.overall_score')}
      FROM chat_res r JOIN (VALUES ('hash-64'), ('no-digits')) AS n(name) ON r.model_name = 'hash-64'
      WHERE n.name = 'hash-64' OR r.doc NOT IN (SELECT doc FROM u_chat_p WHERE {bad} UNION ALL
                                               SELECT doc FROM u_chat_s WHERE {bad})""",
                                "u_chat_p", "u_chat_s", "default_q", "chat_res")
    q["given_vectors_score"] = build(f"""
      SELECT model_name, doc, n_adjacent_pairs, {r6('avg_coherence')}, {r6('section_boundary_contrast')}, n_queries,
             {r6('semantic_search_precision')}, {r6('min_precision')}, {r6('max_precision')},
             {r6('avg_coherence * 0.3 + section_boundary_contrast * 0.3 + semantic_search_precision * 0.4',
                 'overall_score')}
      FROM given_coh JOIN given_con USING (model_name, doc) JOIN given_sp_prec USING (model_name, doc)
      UNION ALL
      SELECT 'given-bare', doc, n_adjacent_pairs, {r6('avg_coherence')}, {r6('section_boundary_contrast')}, NULL, NULL,
             NULL, NULL, NULL FROM given_coh JOIN given_con USING (model_name, doc)""",
                                     "given_coh", "given_con", "given_sp_prec")
    q["embedded_texts"] = """
      SELECT m AS model_name, count(DISTINCT coalesce(text, '')) AS n_texts, CAST(0 AS BIGINT) AS n_failed
      FROM conversations CROSS JOIN (VALUES ('hash-64'), ('hash-256')) AS t(m) GROUP BY m"""
    q["conversation_query_sets"] = f"""
      SELECT conv_id, query_idx, query, array_to_string(keywords, '|') AS keywords
      FROM (SELECT conv_id, CAST(row_number() OVER w - 1 AS BIGINT) AS query_idx, text AS query,
                   list_filter({words('text')}, lambda w: length(w) > 3 AND NOT list_contains(
                     {_list(L.KEYWORD_STOP_WORDS)}, w)) AS keywords,
                   row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n
            FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
      WHERE i < n"""
    q["run_status"] = build(f"""
      SELECT d.doc AS document_name,
             CASE WHEN coalesce(n.n, 0) > 0 THEN 'completed' ELSE 'error' END AS status,
             CASE WHEN coalesce(n.n, 0) > 0 THEN 'Evaluation completed successfully.'
                  ELSE 'No model produced a result.' END AS message,
             CAST(CASE WHEN coalesce(n.n, 0) > 0 THEN 100 ELSE 0 END AS BIGINT) AS progress,
             CAST(coalesce(n.n, 0) AS BIGINT) AS n_models
      FROM {strict_docs} d LEFT JOIN (SELECT doc, count(*) AS n FROM strict_res GROUP BY doc) n USING (doc)""",
                            "strict_res")

    q["stream_ingest"] = build(f"SELECT doc, model_name, {r6('avg_coherence')}, {r6('overall_score')} "
                               "FROM strict_res", "strict_res")
    resent = (f"WITH resent AS (SELECT * REPLACE (CASE WHEN lang = 'de' THEN text || {NL} || {_q(L.LATER_LINE)} "
              "ELSE text END AS text) FROM documents),\n")
    q["stream_reingest"] = resent + q["stream_ingest"].replace("documents", "resent").strip().removeprefix("WITH ")
    q["pairs_scan"] = build(f"SELECT conv_id, turn, {r6('human_score')}, length(text1) AS len1, "
                            f"length(text2) AS len2 FROM pairs", "pairs")
    q["pair_similarity"] = build("SELECT model_name, conv_id, turn, " + ", ".join(
        [r6("human_score"), r6("similarity"), "CAST(embedding_dimension AS BIGINT) AS embedding_dimension"]
        + [r6(f"{e}_{i}") for e in ("e1", "e2") for i in range(5)]) + " FROM pair_sims", "pair_sims")
    q["user_model_pairs"] = build(f"SELECT model_name, conv_id, turn, {r6('similarity')} FROM pair_sims", "pair_sims")
    q["pearson_by_model"] = build(f"SELECT model_name, {r6('pearson_correlation')}, n FROM pearson", "pearson")
    q["spearman_by_model"] = build(f"SELECT model_name, {r6('spearman_correlation')}, n FROM spearman", "spearman")
    q["comparison_table"] = build(f"""
      SELECT CAST(m.model_order AS BIGINT) AS model_order, m.model_name, m.model_id,
             {r6('p.pearson_correlation')}, {r6('s.spearman_correlation')},
             CAST(m.dim AS BIGINT) AS embedding_dimension, p.n AS n_pairs
      FROM pearson p JOIN spearman s USING (model_name) JOIN {MODELS} ON m.model_name = p.model_name""",
                                  "pearson", "spearman")
    q["comparison_display"] = build(f"""
      SELECT CAST(m.model_order AS BIGINT) AS model_order, m.model_name,
             {fixed('p.pearson_correlation', 4)} AS pearson_correlation,
             {fixed('s.spearman_correlation', 4)} AS spearman_correlation,
             CAST(m.dim AS BIGINT) AS embedding_dimension, CAST(NULL AS VARCHAR) AS load_time_seconds,
             CAST(NULL AS VARCHAR) AS average_embedding_time_seconds
      FROM pearson p JOIN spearman s USING (model_name) JOIN {MODELS} ON m.model_name = p.model_name""",
                                    "pearson", "spearman")
    n_queries = len(L.DEFAULT_QUERIES)
    q["evaluation_timing"] = build(f"""
      SELECT r.model_name, r.doc, p.n + coalesce(s.n, 0) + {n_queries} AS n_embedded, true AS measured,
             {r6('r.overall_score')}
      FROM source_res r JOIN (SELECT doc, count(*) AS n FROM u_source_p GROUP BY doc) p USING (doc)
      LEFT JOIN (SELECT doc, count(*) AS n FROM u_source_s GROUP BY doc) s USING (doc)""",
                                   "source_res", "u_source_p", "u_source_s")
    return q
