"""The SQL that the search queries are compared with, written against the tables alone."""

from __future__ import annotations

from postlane.operators.index import MAX_PLACES
from postlane.plans.queries import EDISMAX, OTHER, PHRASES, TERM

ORACLE_SQL: dict[str, str] = {}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(words: list[str]) -> str:
    return "(" + ", ".join(map(_q, words)) + ")"


#: One chain of tables: tokens, places, lengths, statistics, frequencies.
_TOKENS = "tk AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\\S+') AS t FROM documents)"
_REST = """
ps AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM tk),
l AS (SELECT doc_id, len(t) AS dl FROM tk),
st AS (SELECT count(*) AS n, coalesce(avg(dl), 0) AS avgdl FROM l)"""
_BASE = f"WITH {_TOKENS},{_REST}"
_TITLES = "tt AS (SELECT doc_id, t[1:8] AS t FROM tk)"


def _joined(expression: str) -> str:
    return f"WITH x AS (SELECT doc_id, {expression} AS t FROM documents) SELECT doc_id, len(t)::BIGINT AS n_tokens, array_to_string(t, ' ') AS joined FROM x"


_LOWER = "regexp_extract_all(lower(text), '\\S+')"
ORACLE_SQL |= {
    "tokenize_ws": _joined("regexp_extract_all(text, '\\S+')"),
    "tokenize_lower": _joined(_LOWER),
    "tokenize_udf": _joined(_LOWER),
    "tokenize_ws_punc": _joined(f"list_transform({_LOWER}, lambda x: regexp_replace(x, '[[:punct:]]', '', 'g'))"),
    "tokenize_fold": _joined("regexp_extract_all(lower(translate(regexp_replace(text, '[[:punct:]]', ' ', 'g'), '‘’´“”–', '''''''\"\"-')), '\\S+')"),
    "tokenize_keyword": _joined("[lower(text)]"),
    "tokenize_constant": _joined("list_transform(regexp_extract_all(text, '\\S+'), lambda x: 'b')"),
    "token_triples": f"{_BASE} SELECT doc_id, pos::BIGINT AS pos, term FROM ps",
    "build_postings": f"{_BASE} SELECT term, doc_id, count(*) AS tf, string_agg(pos::VARCHAR, ' ' ORDER BY pos) AS places FROM ps GROUP BY term, doc_id",
    "index_roundtrip": f"{_BASE} SELECT term, doc_id, count(*) AS tf FROM ps GROUP BY term, doc_id",
    "doc_lengths": f"{_BASE} SELECT doc_id, dl::BIGINT AS doc_len FROM l",
    "index_truncate": f"{_BASE} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM ps WHERE pos < {MAX_PLACES} GROUP BY term",
    "index_concat": f"{_BASE} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf, max(n) AS n_docs, round(max(avgdl), 6) AS avg_doc_len FROM ps, st GROUP BY term",
    "index_upsert": f"""WITH {_TOKENS.replace('tk AS', 'whole AS')}, tk AS (SELECT w.doc_id, CASE WHEN d.lang = 'fr' THEN w.t[1:8] ELSE w.t END AS t FROM whole w JOIN documents d USING (doc_id)),{_REST}
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf, max(n) AS n_docs, round(max(avgdl), 6) AS avg_doc_len FROM ps, st GROUP BY term""",
    "term_stats": f"{_BASE} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM ps GROUP BY term",
    "part_terms": "WITH x AS (SELECT p_partkey AS k, unnest(regexp_extract_all(p_name, '\\S+')) AS term FROM part) SELECT term, count(DISTINCT k) AS df, count(*) AS cf FROM x GROUP BY term",
    "docfreq": f"{_BASE}, w AS (SELECT unnest([{_q(TERM)}, {_q(OTHER)}, 'no-such-word']) AS term) SELECT w.term, count(DISTINCT ps.doc_id) AS df FROM w LEFT JOIN ps USING (term) GROUP BY w.term",
    "corpus_stats": f"{_BASE} SELECT n AS n_docs, round(avgdl, 6) AS avg_doc_len FROM st",
    "memory_report_top_terms": f"""{_BASE}, s AS (SELECT term, (8 * count(DISTINCT doc_id) + 4 * count(*))::BIGINT AS n_bytes FROM ps GROUP BY term ORDER BY n_bytes DESC, term LIMIT 10)
SELECT term, n_bytes, (sum(n_bytes) OVER (ORDER BY n_bytes DESC, term ROWS UNBOUNDED PRECEDING))::BIGINT AS running_bytes FROM s""",
}


def _phrase_ctes(words: list[str], condition: str = "TRUE", name: str = "f") -> str:
    """`name`(doc_id, tf): occurrences of the phrase; those of a leading pair of the same word that don't overlap."""
    if len(words) == 1:
        return f"{name} AS (SELECT doc_id, count(*) AS tf FROM ps WHERE term = {_q(words[0])} AND {condition} GROUP BY doc_id)"
    froms = f"(SELECT doc_id, pos FROM ps WHERE term = {_q(words[0])} AND {condition}) a0"
    for k, w in enumerate(words[1:], 1):
        froms += f" JOIN (SELECT doc_id, pos FROM ps WHERE term = {_q(w)} AND {condition}) a{k} ON a{k}.doc_id = a0.doc_id AND a{k}.pos = a0.pos + {k}"
    exact = f"SELECT a0.doc_id, count(*) AS tf FROM {froms} GROUP BY a0.doc_id"
    if words[0] != words[1]:
        return f"{name} AS ({exact})"
    return f"""{name}_e AS ({exact}),
{name}_i AS (SELECT doc_id, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM ps WHERE term = {_q(words[0])} AND {condition}),
{name}_r AS (SELECT doc_id, island, count(*) // 2 AS pairs FROM {name}_i GROUP BY doc_id, island),
{name}_c AS (SELECT doc_id, sum(pairs) AS cap FROM {name}_r GROUP BY doc_id),
{name} AS (SELECT doc_id, least(tf, cap)::BIGINT AS tf FROM {name}_e JOIN {name}_c USING (doc_id) WHERE least(tf, cap) > 0)"""


def _freqs(words: list[str], condition: str = "TRUE") -> str:
    return f"{_BASE},\n{_phrase_ctes(words, condition)}\nSELECT l.doc_id, coalesce(tf, 0)::BIGINT AS tf FROM l LEFT JOIN f USING (doc_id)"


_NEAR = """{base}, w AS (SELECT doc_id, term, pos FROM ps WHERE term IN {words}),
m AS (SELECT a.doc_id, a.pos, count(DISTINCT b.term) AS k FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos AND a.pos + {width} GROUP BY a.doc_id, a.pos)
SELECT DISTINCT doc_id FROM m WHERE k = {n}"""

ORACLE_SQL |= {name: _freqs(words) for name, words in PHRASES.items()} | {
    "termfreqs_term": _freqs([TERM]),
    "termfreqs_posn_range": _freqs([TERM], "pos BETWEEN 18 AND 89"),
    "phrase_posn_range": _freqs(PHRASES["phrase_2"], "pos BETWEEN 0 AND 89"),
    "phrase_slop": _NEAR.format(base=_BASE, words=_list(["of", "the", "to"]), width=5, n=3),
    "positions": f"{_BASE} SELECT doc_id, pos::BIGINT AS pos FROM ps WHERE term = {_q(TERM)}",
    "and_query": f"{_BASE} SELECT doc_id FROM ps WHERE term IN {_list([TERM, OTHER, 'to'])} GROUP BY doc_id HAVING count(DISTINCT term) = 3",
    "or_query_mm": f"{_BASE} SELECT doc_id FROM ps WHERE term IN {_list([TERM, OTHER, 'to', 'que', 'der'])} GROUP BY doc_id HAVING count(DISTINCT term) >= 2",
}


def _idf(words: list[str], source: str = "ps") -> str:
    """The sum over the words, repeated ones each time, of their idf."""
    one = "(SELECT ln(1 + (n - df + 0.5) / (df + 0.5)) FROM (SELECT count(DISTINCT doc_id) AS df FROM {source} WHERE term = {word}))"
    return "(" + " + ".join(one.format(source=source, word=_q(w)) for w in words) + ")"


def _bm25(k1: float = 1.2, b: float = 0.75) -> str:
    return f"(tf / (tf + {k1} * ({1 - b}::DOUBLE + {b}::DOUBLE * dl / avgdl)))"


def _scores(words: list[str], value: str, condition: str = "TRUE") -> str:
    return f"{_BASE},\n{_phrase_ctes(words, condition)}\nSELECT l.doc_id, round(coalesce({value}, 0)::DOUBLE, 6) AS score FROM l CROSS JOIN st LEFT JOIN f USING (doc_id)"


_DF = f"(SELECT count(DISTINCT doc_id) FROM ps WHERE term = {_q(TERM)})"
ORACLE_SQL |= {
    "score_bm25_term": _scores([TERM], f"{_idf([TERM])} * {_bm25()}"),
    "score_bm25_phrase": _scores(PHRASES["phrase_3"], f"{_idf(PHRASES['phrase_3'])} * {_bm25()}"),
    "score_bm25_repeated": _scores(PHRASES["phrase_same_term"], f"{_idf(PHRASES['phrase_same_term'])} * {_bm25()}"),
    "score_bm25_impact": _scores([TERM], _bm25()),
    "score_bm25_legacy": _scores([TERM], f"{_idf([TERM])} * {_bm25()} * 2.2"),
    "score_bm25_tuned": _scores([TERM], f"{_idf([TERM])} * {_bm25(10, 0.01)}"),
    "score_classic": _scores([TERM], f"CASE WHEN dl > 0 THEN (ln((n + 1.0) / ({_DF} + 1.0)) + 1) * sqrt(tf) / sqrt(dl) END"),
    "score_custom_sim": _scores([TERM], "sqrt(tf) / ln(dl + 2.0)"),
    "score_posn_range": _scores([TERM], f"{_idf([TERM])} * {_bm25()}", "pos >= 18"),
    "topk_bm25": _scores([TERM], f"{_idf([TERM])} * {_bm25()}").replace("SELECT l.doc_id, round(coalesce(", "SELECT doc_id, round(s, 6) AS score FROM (SELECT l.doc_id, (coalesce(").replace("::DOUBLE, 6) AS score FROM l", "::DOUBLE) AS s FROM l") + ") ORDER BY s DESC, doc_id LIMIT 10",
    "index_from_maps": f"""WITH {_TOKENS}, ps AS (SELECT doc_id, unnest(t) AS term FROM tk), l AS (SELECT doc_id, len(list_distinct(t)) AS dl FROM tk), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
f AS (SELECT doc_id, count(*) AS tf FROM ps WHERE term = {_q(TERM)} GROUP BY doc_id)
SELECT l.doc_id, round(coalesce({_idf([TERM])} * {_bm25()}, 0)::DOUBLE, 6) AS score FROM l CROSS JOIN st LEFT JOIN f USING (doc_id)""",
    "slice_then_score": f"""{_BASE}, c AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), chosen AS (SELECT ps.* FROM ps SEMI JOIN c USING (doc_id)),
f AS (SELECT doc_id, count(*) AS tf FROM chosen WHERE term = {_q(TERM)} GROUP BY doc_id)
SELECT l.doc_id, round(coalesce({_idf([TERM], 'chosen')} * {_bm25()}, 0)::DOUBLE, 6) AS score FROM l SEMI JOIN c USING (doc_id) CROSS JOIN st LEFT JOIN f USING (doc_id)""",
    "topk_multi_query": f"""{_BASE}, w AS (SELECT unnest([{_q(TERM)}, {_q(OTHER)}, 'que']) AS query), f AS (SELECT term AS query, doc_id, count(*) AS tf FROM ps GROUP BY term, doc_id), g AS (SELECT query, count(*) AS df FROM f GROUP BY query),
s AS (SELECT w.query, l.doc_id, coalesce(ln(1 + (n - df + 0.5) / (df + 0.5)) * {_bm25()}, 0) AS score FROM w CROSS JOIN l CROSS JOIN st LEFT JOIN g ON g.query = w.query LEFT JOIN f ON f.query = w.query AND f.doc_id = l.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query, rank::BIGINT AS rank, doc_id, round(score::DOUBLE, 6) AS score, lang, source FROM r JOIN documents USING (doc_id) WHERE rank <= 5""",
}


def _field_ctes(field: str) -> str:
    """tokens, places, lengths and statistics of a field, names ending in the field's."""
    words = {"body": "SELECT doc_id, t FROM tk", "title": "SELECT doc_id, t FROM tt", "exact_title": "SELECT doc_id, [lower(array_to_string(t, ' '))] AS t FROM tt"}[field]
    return f"""tk_{field} AS ({words}),
ps_{field} AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM tk_{field}),
l_{field} AS (SELECT doc_id, len(t) AS dl FROM tk_{field}),
st_{field} AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l_{field})"""


def _edismax(qf: list[str], q: str = "of the", mm: int | str | None = None, pf=(), pf2=(), pf3=(), tie: float = 0.0, q_op: str = "OR") -> str:
    split = lambda x: (x.partition("^")[0], float(x.partition("^")[2] or 1))
    boosts = dict(map(split, qf))
    terms = {f: [q.lower()] if f == "exact_title" else q.split() for f in boosts}
    count = {f: len(t) for f, t in terms.items()}
    central = len(set(count.values())) == 1
    # minimum-should-match by hand for the specifications used here
    need = {f: {None: 1, "2<-25%": n if n <= 2 else n - n // 4, "60%": n * 60 // 100}.get(mm, mm if isinstance(mm, int) else 1) for f, n in count.items()}
    need = {f: count[f] if q_op == "AND" else min(n, count[f]) for f, n in need.items()}
    out = [_TOKENS, _TITLES, *map(_field_ctes, boosts)]
    for f, b in boosts.items():
        values = ", ".join(f"({k}, {_q(t)})" for k, t in enumerate(terms[f]))
        out.append(f"""qt_{f}(ord, term) AS (VALUES {values}),
tf_{f} AS (SELECT term, doc_id, count(*) AS tf FROM ps_{f} WHERE term IN (SELECT term FROM qt_{f}) GROUP BY term, doc_id),
df_{f} AS (SELECT term, count(*) AS df FROM tf_{f} GROUP BY term),
sc_{f} AS (SELECT doc_id, ord, {_q(f)} AS field, {b if central else 1.0}::DOUBLE * ln(1 + (n - df + 0.5) / (df + 0.5)) * {_bm25()} AS s
  FROM qt_{f} JOIN tf_{f} USING (term) JOIN df_{f} USING (term) JOIN l_{f} USING (doc_id) CROSS JOIN st_{f})""")
    out.append("sc AS (" + " UNION ALL ".join(f"SELECT * FROM sc_{f}" for f in boosts) + ")")
    if central:
        out.append(f"dm AS (SELECT doc_id, ord, max(s) + (sum(s) - max(s)) * {tie}::DOUBLE AS d FROM sc GROUP BY doc_id, ord)")
        out.append(f"qf AS (SELECT doc_id, sum(d) AS q FROM dm GROUP BY doc_id HAVING count(*) FILTER (d > 0) >= {next(iter(need.values()))})")
    else:
        rows = ", ".join(f"({_q(f)}, {need[f]}, {b}::DOUBLE)" for f, b in boosts.items())
        out.append(f"fb(field, need, boost) AS (VALUES {rows})")
        out.append("fs AS (SELECT doc_id, field, sum(s) AS s, count(*) FILTER (s > 0) AS n FROM sc GROUP BY doc_id, field)")
        out.append(f"qf AS (SELECT doc_id, max(s * boost) + (sum(s * boost) - max(s * boost)) * {tie}::DOUBLE AS q FROM fs JOIN fb USING (field) WHERE n >= need GROUP BY doc_id)")
    parts = []
    for size, wanted in ((0, pf), (2, pf2), (3, pf3)):
        for f, b in map(split, wanted):
            n = size or count[f]
            grams = [terms[f][k : k + n] for k in range(count[f] - n + 1)]
            if n < 2 or not grams:
                continue
            for g in grams + ([grams[-1]] if size == 2 else []):
                name = f"p{len(parts)}"
                out.append(f"{name}_ps AS (SELECT * FROM ps_{f} SEMI JOIN qf USING (doc_id))")
                out.append(_phrase_ctes(g, name=name).replace("FROM ps ", f"FROM {name}_ps "))
                parts.append(f"SELECT doc_id, {b}::DOUBLE * {_idf(g, f'{name}_ps')} * {_bm25()} AS p FROM {name} JOIN l_{f} USING (doc_id) CROSS JOIN st_{f}")
    extra = "SELECT doc_id, sum(p) AS p FROM (" + " UNION ALL ".join(parts) + ") GROUP BY doc_id" if parts else "SELECT doc_id, 0.0 AS p FROM qf"
    out.append(f"px AS ({extra})")
    return "WITH " + ",\n".join(out) + "\nSELECT d.doc_id, round((coalesce(q, 0) + coalesce(p, 0))::DOUBLE, 6) AS score FROM documents d LEFT JOIN qf USING (doc_id) LEFT JOIN px USING (doc_id)"


ORACLE_SQL |= {name: _edismax(**parameters) for name, parameters in EDISMAX.items()}

_SETS = f"WITH {_TOKENS}, {_TITLES}, s AS (SELECT doc_id, list_sort(list_distinct(t)) AS terms, len(t) AS doc_len FROM tk)"
ORACLE_SQL |= {
    "doc_terms": f"{_BASE} SELECT term, count(*) AS tf, string_agg(pos::VARCHAR, ' ' ORDER BY pos) AS places FROM ps WHERE doc_id = 7 GROUP BY term",
    "take_rows": f"""{_SETS}, w(ord, doc_id) AS (VALUES (0, 5), (1, 3), (2, 3), (3, -1), (4, 8))
SELECT w.ord::BIGINT AS ord, w.doc_id::BIGINT AS doc_id, coalesce(array_to_string(terms, ' '), '') AS terms, coalesce(doc_len, 0)::BIGINT AS doc_len FROM w LEFT JOIN s USING (doc_id)""",
    "row_equality": f"{_SETS} SELECT s.doc_id, list_sort(list_distinct(tt.t)) = s.terms AND len(tt.t) = s.doc_len AS equal FROM s JOIN tt USING (doc_id)",
    "isna_docs": "SELECT doc_id, lang IS NULL OR lang = 'es' OR text IS NULL OR NOT regexp_matches(text, '\\S') AS missing FROM documents",
    "value_counts": f"{_SETS} SELECT array_to_string(terms, ' ') AS terms, doc_len::BIGINT AS doc_len, count(*) AS n FROM s WHERE doc_len > 0 GROUP BY ALL",
    "unique_docs": f"{_SETS} SELECT DISTINCT array_to_string(terms, ' ') AS terms, doc_len::BIGINT AS doc_len FROM s",
    "memory_usage": f"{_BASE} SELECT (8 * (SELECT count(*) FROM (SELECT DISTINCT term, doc_id FROM ps)) + 4 * (SELECT count(*) FROM ps) + 4 * (SELECT count(*) FROM l))::BIGINT AS n_bytes",
    "factorize": f"{_SETS} SELECT doc_id, CASE WHEN doc_len = 0 THEN -1 ELSE min(doc_id) OVER w END AS code, CASE WHEN doc_len = 0 THEN 0 ELSE count(*) OVER w END AS n FROM s WINDOW w AS (PARTITION BY terms, doc_len)",
    "dense_frequencies": f"{_BASE} SELECT l.doc_id, count(*) FILTER (term = {_q(TERM)}) AS tf_0, count(*) FILTER (term = {_q(OTHER)}) AS tf_1 FROM l LEFT JOIN ps USING (doc_id) GROUP BY l.doc_id",
    "keys_intersect": f"{_BASE} SELECT doc_id FROM ps WHERE term = {_q(OTHER)} INTERSECT SELECT doc_id FROM ps WHERE term = {_q(TERM)}",
    "keys_rows_in": f"{_BASE} SELECT doc_id, pos::BIGINT AS pos FROM ps WHERE term = {_q(OTHER)} AND doc_id IN (SELECT doc_id FROM ps WHERE term = {_q(TERM)})",
    "keys_adjacent": f"{_BASE} SELECT DISTINCT a.doc_id, a.pos::BIGINT AS pos FROM ps a JOIN ps b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = {_q(OTHER)} AND b.term = {_q(TERM)}",
    "keys_merge": f"{_BASE} SELECT DISTINCT doc_id FROM ps WHERE term IN {_list([OTHER, TERM])}",
    "keys_merge_counts": f"{_BASE} SELECT doc_id, count(*) AS n FROM ps WHERE term IN {_list([OTHER, TERM])} GROUP BY doc_id",
    "keys_bits": "SELECT doc_id, bit_count(doc_id)::BIGINT AS bits FROM documents",
}

#: An array of a document's words, sorted, each with its bytes turned round and closed by a mark above them: its order is that of the documents.
ORACLE_SQL["sort_docs"] = f"""WITH {_TOKENS}, k AS (SELECT doc_id, list_transform(list_sort(t), lambda x: translate(hex(encode(x)), '0123456789ABCDEF', 'FEDCBA9876543210') || 'G') AS key FROM tk)
SELECT doc_id, row_number() OVER (ORDER BY key, doc_id)::INTEGER AS rank FROM k"""

#: By hand: a number, or a share of the clauses rounded towards 0, or what is left without it; conditions hold above their number.
_LEAST = {
    "2": "least(2, n)", "-1": "n - 1", "75%": "n * 75 // 100", "-25%": "n - n * 25 // 100", "2<-25%": "CASE WHEN n > 2 THEN n - n * 25 // 100 ELSE n END",
    "3<90%": "CASE WHEN n > 3 THEN n * 90 // 100 ELSE n END", "2<-1 5<80%": "CASE WHEN n > 5 THEN n * 80 // 100 WHEN n > 2 THEN n - 1 ELSE n END",
}
_EXPLAINED = {
    "edismax_term_centric": "((title:of^1 | body:of^1) (title:the^1 | body:the^1))~1",
    "edismax_tie": "((title:of^1 | body:of^1) (title:the^1 | body:the^1))~1",
    "edismax_mm": "((title:of^1 | body:of^1) (title:the^1 | body:the^1) (title:to^1 | body:to^1) (title:and^1 | body:and^1))~3",
    "edismax_boost": "((title:of^2.0 | body:of^0.5) (title:the^2.0 | body:the^0.5))~1",
    "edismax_and": "((title:of^1 | body:of^1) (title:the^1 | body:the^1))~2",
    "edismax_field_centric": "((exact_title:of the)~1)^3.0 | ((body:of body:the)~2)^1",
    "edismax_pf": '((title:of^1 | body:of^1) (title:the^1 | body:the^1))~2 (title:"of the")^2.0 (body:"of the")^1',
    "edismax_pf2": '((title:of^1 | body:of^1) (title:the^1 | body:the^1) (title:to^1 | body:to^1))~1 (body:"of the")^3.0 (body:"the to")^3.0',
    "edismax_pf3": '((title:The^1 | body:The^1) (title:and^1 | body:and^1) (title:attion^1 | body:attion^1) (title:to^1 | body:to^1))~1 (body:"The and attion")^1 (body:"and attion to")^1',
    "edismax_full": '((title:The^2.0 | body:The^1) (title:and^2.0 | body:and^1) (title:attion^2.0 | body:attion^1) (title:to^2.0 | body:to^1))~2 (body:"The and attion to")^1 (title:"The and")^1 (title:"and attion")^1 (title:"attion to")^1 (body:"The and")^0.5 (body:"and attion")^0.5 (body:"attion to")^0.5 (body:"The and attion")^2.0 (body:"and attion to")^2.0',
}
ORACLE_SQL |= {
    "mm_clauses": " UNION ALL ".join(f"SELECT {_q(spec)} AS spec, n AS clauses, ({least})::BIGINT AS least FROM range(1, 13) AS r(n)" for spec, least in _LEAST.items()),
    "edismax_explained": "SELECT * FROM (VALUES " + ", ".join(f"({_q(k)}, {_q(v)})" for k, v in _EXPLAINED.items()) + ") AS v(name, explained)",
    "read_tsv": "SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\t\\n\\r]', ' ', 'g') AS text FROM documents",
    "read_json_map": "SELECT doc_id, 't' AS title, coalesce(text, '') AS body, '' AS none FROM documents",
    "stream_index": ORACLE_SQL["termfreqs_term"],
}
