"""DuckDB SQL of the queries, over the same tables."""

from __future__ import annotations

from lodestone.functions import fixed as V
from lodestone.functions.stem import STEP2, STEP3, STEP4
from lodestone.plans import fixtures as X


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, list):
        return "[" + ", ".join(map(lit, v)) + "]::VARCHAR[]"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def values(rows, name: str, *columns: str) -> str:
    return f"{name}({', '.join(columns)}) AS (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"


def words(items) -> str:
    return "(" + ", ".join(map(lit, items)) + ")"


SQL: dict[str, str] = {}

# kNN ------------------------------------------------------------------------

KNN = """
WITH c AS (SELECT vec_id AS chunk_id, 'src/m' || label || '/f' || (vec_id % 20) || '.ts' AS file_path, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS w FROM embeddings WHERE vec_id < {below}),
s AS (SELECT query_id, chunk_id, file_path, list_cosine_similarity(v, w) AS similarity FROM c, q {where}),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, chunk_id) AS near FROM s)
"""
SQL["knn_topk"] = KNN.format(below=1, where="") + "SELECT query_id, chunk_id, file_path, round(similarity, 6) AS similarity, CAST(near AS INTEGER) AS vec_rank FROM n WHERE near <= 10"
SQL["knn_multi_query"] = KNN.format(below=5, where="") + "SELECT query_id, chunk_id, file_path, round(similarity, 6) AS similarity, CAST(near AS INTEGER) AS vec_rank FROM n WHERE near <= 10"
SQL["knn_threshold"] = KNN.format(below=3, where="") + """
SELECT query_id, CAST(near AS INTEGER) AS rank, chunk_id, file_path, 1 AS start_line, 9 AS end_line, round(similarity, 6) AS similarity FROM n WHERE near <= 10 AND similarity >= 0.2"""
SQL["knn_prefix_compat"] = KNN.format(below=3, where="") + """,
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY near) AS INTEGER) AS vec_rank FROM n WHERE near <= 40 AND starts_with(file_path, 'src/m1/'))
SELECT query_id, chunk_id, file_path, round(similarity, 6) AS similarity, vec_rank FROM k WHERE vec_rank <= 10"""
SQL["knn_prefix_exact"] = KNN.format(below=3, where="WHERE starts_with(file_path, 'src/m1/')") + "SELECT query_id, chunk_id, file_path, round(similarity, 6) AS similarity, CAST(near AS INTEGER) AS vec_rank FROM n WHERE near <= 10"

# Full text ------------------------------------------------------------------

DOC_PATH = "source || '/' || lang || '/' || doc_id || '.' || (['ts', 'md', 'test.ts', 'json', 'py'])[CAST(doc_id % 5 + 1 AS INT)]"
# query, phrase, part of the narrow tier, query has that tier, terms: what the queries of FTS_QUERIES compile to.
PHRASES = [
    (0, "thing", True, True, ["thing"]), (0, "tion", True, True, ["tion"]), (0, "ther", True, True, ["ther"]),
    (1, "thing", False, False, ["thing"]), (1, "edble", False, False, ["edble"]),
    (2, "zqx", True, True, ["zqx"]), (2, "unknown", True, True, ["unknown"]), (2, "wordless", True, True, ["wordless"]),
    (3, "threlyes_ofthstthor", False, False, ["threlyes", "ofthstthor"]), (3, "threlyes", False, False, ["threlyes"]), (3, "ofthstthor", False, False, ["ofthstthor"]),
    (3, "auth", False, False, ["auth"]), *[(3, w, False, False, [w]) for w in V.SYNONYMS["auth"]],
    (4, "ourThing", True, True, ["ourthing"]), (4, "Thing", False, True, ["thing"]), (4, "eres", True, True, ["eres"]), (4, "oner", True, True, ["oner"]),
]


def tokens(x: str) -> str:
    return f"regexp_extract_all(strip_accents(lower({x})), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+')"


def identifiers(x: str) -> str:
    """Identifiers of a text and their parts, as in identifier_split; in no order that phrases of one word would see."""
    ids = f"list_filter(regexp_extract_all({x}, '[a-zA-Z_$][a-zA-Z0-9_$]+'), lambda w: (regexp_matches(w, '[a-z][A-Z]') OR contains(w, '_')) AND NOT (lower(w) IN {words(V.STOP_WORDS)} AND length(w) < 6))"
    parts = f"list_concat([w], CASE WHEN regexp_matches(w, '[a-z][A-Z]') THEN string_split(regexp_replace(regexp_replace(w, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), ' ') ELSE [] END, CASE WHEN contains(w, '_') THEN list_filter(string_split(w, '_'), lambda y: y <> '') ELSE [] END)"
    return f"array_to_string(flatten(list_transform(list_distinct({ids}), lambda w: {parts})), ' ')"


def found(f: str) -> str:
    """How often the terms stand in a row in a field."""
    return f"CASE WHEN len(terms) = 1 THEN len(list_filter({f}, lambda x: x = terms[1])) ELSE len(list_filter(range(1, len({f}) - len(terms) + 2), lambda i: {f}[i] = terms[1] AND {f}[i:i + len(terms) - 1] = terms)) END"


def stems(f: str) -> str:
    return f


BM25 = f"""
WITH {values(PHRASES, 'p', 'query_id', 'phrase', 'narrow', 'tiered', 'terms')},
{values(X.FTS_QUERIES, 'fq', 'query_id', 'query_text')},
d AS (SELECT doc_id AS chunk_id, {DOC_PATH} AS file_path, text FROM documents),
fd AS (SELECT chunk_id, file_path, {tokens('file_path')} AS f0, {tokens('text')} AS f1, {tokens(identifiers('text'))} AS f2 FROM d),
tk AS MATERIALIZED (SELECT chunk_id, file_path, {stems('f0')} AS f0, {stems('f1')} AS f1, {stems('f2')} AS f2, len(f0) + len(f1) + len(f2) AS n_terms FROM fd),
st AS (SELECT count(*) AS n_all, avg(n_terms) AS mean FROM tk),
tf AS (SELECT query_id, phrase, narrow, tiered, chunk_id, n_terms, file_path, {found('f0')} + {found('f1')} + {found('f2')} AS tf FROM tk, p),
t AS (SELECT *, count(*) OVER (PARTITION BY query_id, phrase) AS df FROM tf WHERE tf > 0),
s AS (SELECT *, -(CASE WHEN ln((n_all - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_all - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_terms / mean)) AS score FROM t, st),
c AS (SELECT query_id, chunk_id, file_path, tiered, sum(score) AS any_score, sum(score) FILTER (narrow) AS all_score, count(*) FILTER (narrow) AS hits FROM s GROUP BY ALL),
w AS (SELECT c.*, tiered AND hits = (SELECT count(*) FROM p WHERE p.query_id = c.query_id AND p.narrow) AS whole FROM c {{where}}),
m AS (SELECT *, {{narrowed}} AS narrowed FROM w),
f AS (SELECT query_id, chunk_id, file_path, CASE WHEN narrowed THEN all_score ELSE any_score END AS bm25 FROM m WHERE whole OR NOT narrowed),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9), chunk_id) AS INTEGER) AS fts_rank FROM f)
"""
TIERED = "max(CAST(whole AS INT)) OVER (PARTITION BY query_id) = 1"


def bm25(narrowed=TIERED, where="") -> str:
    return BM25.replace("{narrowed}", narrowed).replace("{where}", where)


RANKED = "SELECT query_id, chunk_id, round(bm25, 6) AS bm25, fts_rank FROM r"
SQL["bm25_or"] = bm25("FALSE") + RANKED
SQL["bm25_and"] = bm25("TRUE") + RANKED
SQL["bm25_tiered"] = bm25() + RANKED
SQL["bm25_prefix"] = bm25(where="WHERE starts_with(lower(file_path), 'src1/')") + RANKED


def porter_steps() -> str:
    """CTEs from vocab (w) to stem (w, s), the published algorithm on distinct words; Y is a consonant y."""
    v, c = "[aeiouy]", "[^aeiouy]"
    cut = lambda n: f"left(x, length(x) - {n})"
    m0 = lambda x: f"regexp_matches({x}, '^{c}*{v}+{c}')"
    m1 = lambda x: f"regexp_matches({x}, '^{c}*{v}+{c}+{v}+{c}')"
    cvc = lambda x: f"regexp_matches({x}, '{c}{v}[^aeiouywxY]$')"
    double = f"(length(x) > 1 AND right(x, 1) = substr(x, length(x) - 1, 1) AND regexp_matches(x, '{c}$'))"
    has = lambda x: f"regexp_matches({x}, '{v}')"
    ends = lambda e: f"suffix(x, '{e}')"

    def table(pairs, ok) -> str:
        return "CASE " + " ".join(f"WHEN {ends(a)} THEN CASE WHEN {ok(a, cut(len(a)))} THEN {cut(len(a))} || '{b}' ELSE x END" for a, b in sorted(pairs, key=lambda ab: -len(ab[0]))) + " ELSE x END"

    steps = [
        f"CASE WHEN {ends('sses')} OR {ends('ies')} THEN {cut(2)} WHEN {ends('ss')} THEN x WHEN {ends('s')} THEN {cut(1)} ELSE x END",
        # The mark ~ stands where ed or ing went.
        f"CASE WHEN {ends('eed')} THEN CASE WHEN {m0(cut(3))} THEN {cut(1)} ELSE x END WHEN {ends('ed')} THEN CASE WHEN {has(cut(2))} THEN '~' || {cut(2)} ELSE x END WHEN {ends('ing')} AND {has(cut(3))} THEN '~' || {cut(3)} ELSE x END",
        "CASE WHEN NOT starts_with(x, '~') THEN x ELSE (SELECT CASE WHEN regexp_matches(x, '(at|bl|iz)$') THEN x || 'e' "
        f"WHEN {double} AND NOT regexp_matches(x, '[lsz]$') THEN {cut(1)} WHEN {m0('x')} AND NOT {m1('x')} AND {cvc('x')} THEN x || 'e' ELSE x END FROM (SELECT substr(z.x, 2) AS x)) END",
        f"CASE WHEN regexp_matches(x, '[yY]$') AND {has(cut(1))} THEN {cut(1)} || 'i' ELSE x END",
        table(STEP2.items(), lambda _, stem: m0(stem)),
        table(STEP3.items(), lambda _, stem: m0(stem)),
        table([(a, "") for a in STEP4], lambda a, stem: m1(stem) + (f" AND regexp_matches({stem}, '[st]$')" if a == "ion" else "")),
        f"CASE WHEN {ends('e')} AND ({m1(cut(1))} OR {m0(cut(1))} AND NOT {cvc(cut(1))}) THEN {cut(1)} ELSE x END",
        f"CASE WHEN {double} AND {ends('l')} AND {m1(cut(1))} THEN {cut(1)} ELSE x END",
    ]
    out = "z0 AS MATERIALIZED (SELECT w, regexp_replace(regexp_replace(regexp_replace(w, '^y', 'Y'), '([aeiou])y', '\\1Y', 'g'), 'yy', 'yY', 'g') AS x FROM vocab WHERE regexp_matches(w, '^[a-z]{3,}$'))"
    for i, step in enumerate(steps, 1):
        out += f",\nz{i} AS MATERIALIZED (SELECT w, {step} AS x FROM z{i - 1} z)"
    return out + f",\nstem AS MATERIALIZED (SELECT w, lower(x) AS s FROM z{len(steps)} UNION ALL SELECT w, w FROM vocab WHERE NOT regexp_matches(w, '^[a-z]{{3,}}$'))"


def porter() -> str:
    """bm25() over stems: the tokens and the queries' terms are replaced by theirs."""
    tk = f"""ub AS MATERIALIZED (SELECT chunk_id, file_path, fld, unnest(f) AS tok, generate_subscripts(f, 1) AS pos FROM (SELECT chunk_id, file_path, 0 AS fld, f0 AS f FROM fd UNION ALL SELECT chunk_id, file_path, 1, f1 FROM fd UNION ALL SELECT chunk_id, file_path, 2, f2 FROM fd)),
vocab AS MATERIALIZED (SELECT DISTINCT tok AS w FROM ub UNION SELECT unnest(terms) FROM p0),
{porter_steps()},
p AS MATERIALIZED (SELECT query_id, phrase, narrow, tiered, list(s ORDER BY n) AS terms FROM (SELECT *, unnest(terms) AS t, generate_subscripts(terms, 1) AS n FROM p0) JOIN stem ON t = w GROUP BY ALL),
tk AS MATERIALIZED (SELECT chunk_id, file_path, coalesce(list(s ORDER BY pos) FILTER (fld = 0), []) AS f0, coalesce(list(s ORDER BY pos) FILTER (fld = 1), []) AS f1, coalesce(list(s ORDER BY pos) FILTER (fld = 2), []) AS f2, count(*) AS n_terms
  FROM ub JOIN stem ON tok = w GROUP BY chunk_id, file_path),
"""
    plain = bm25()
    a, b = plain.index("tk AS MATERIALIZED"), plain.index("st AS (SELECT count(*) AS n_all")
    return (plain[:a] + tk + plain[b:]).replace("p(query_id, phrase", "p0(query_id, phrase", 1)


SQL["bm25_porter"] = porter() + RANKED
SQL["bm25_phrase"] = bm25() + "SELECT query_id, phrase, chunk_id, CAST(tf AS BIGINT) AS tf FROM t"

MULTIPLIER = """CASE WHEN regexp_matches(lower({p}), '(^|/)readme\\.md$') THEN 0.5::DOUBLE WHEN suffix(lower({p}), '.md') THEN 0.7
 WHEN regexp_matches(lower({p}), '\\.(test|spec)\\.[^.]+$') OR regexp_matches(lower({p}), '__(tests|test)__') OR contains(lower({p}), '/test/') THEN 0.85
 WHEN regexp_matches(lower({p}), '\\.(json|ya?ml|toml|ini|cfg|conf)$') OR regexp_matches(lower({p}), '(^|/)\\.[^/]*$') THEN 0.8 ELSE 1.0 END"""
IDS = "list_filter(regexp_extract_all({q}, '[a-zA-Z_$][a-zA-Z0-9_$]{{2,}}'), lambda w: regexp_matches(w, '[a-z][A-Z]') OR contains(w, '_'))"


def multiplier(p: str) -> str:
    return MULTIPLIER.replace("{p}", p)


def boost(q: str, t: str) -> str:
    return f"least(2.5::DOUBLE, 1.0 + 0.5 * len(list_filter({IDS.format(q=q)}, lambda w: contains({t}, w))))"


NORMAL = """, top AS (SELECT * FROM r WHERE fts_rank <= 20),
nb AS (SELECT *, CASE WHEN min(bm25) OVER w = max(bm25) OVER w THEN 1.0::DOUBLE ELSE (max(bm25) OVER w - bm25) / (max(bm25) OVER w - min(bm25) OVER w) END AS bm25_norm FROM top WINDOW w AS (PARTITION BY query_id))"""
LEXICAL = bm25() + NORMAL + f""", sc AS (SELECT nb.*, d.text, bm25_norm * {multiplier('nb.file_path')} * {boost('query_text', 'd.text')} AS score FROM nb JOIN d USING (chunk_id) JOIN fq USING (query_id)),
z AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, fts_rank) AS INTEGER) AS rank FROM sc)
"""
SQL["lexical_search"] = LEXICAL + """SELECT query_id, rank, chunk_id, file_path, 1 AS start_line, CAST(len(string_split(text, chr(10))) AS INTEGER) AS end_line, 0.0::DOUBLE AS similarity, round(score, 6) AS score FROM z WHERE rank <= 10"""
SQL["shown_hits"] = LEXICAL.replace("fts_rank <= 20", "fts_rank <= 10") + """SELECT query_id, rank, file_path AS file, '1-' || len(string_split(text, chr(10))) AS lines, 0.0::DOUBLE AS similarity, round(score, 3) AS score,
 CASE WHEN length(text) > 400 THEN text[1:400] || '…' ELSE text END AS preview FROM z WHERE rank <= 5"""

# Fusion ---------------------------------------------------------------------

FUSE = bm25() + NORMAL + """, q AS (SELECT fq.query_id, query_text, CAST(embedding AS DOUBLE[]) AS w FROM fq JOIN embeddings ON vec_id = query_id),
vs AS (SELECT query_id, chunk_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), w) AS similarity FROM d JOIN embeddings ON vec_id = chunk_id, q),
vr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, chunk_id) AS INTEGER) AS vec_rank FROM vs),
fu AS (SELECT coalesce(v.query_id, b.query_id) AS query_id, coalesce(v.chunk_id, b.chunk_id) AS chunk_id, v.similarity AS vec_similarity, coalesce(v.similarity, 0.0) AS similarity, vec_rank, bm25_norm, fts_rank,
  coalesce(1.0::DOUBLE / (60 + vec_rank), 0) + coalesce(1.0::DOUBLE / (60 + fts_rank), 0) AS rrf
  FROM (SELECT * FROM vr WHERE vec_rank <= 20) v FULL JOIN (SELECT * FROM nb WHERE query_id IN (SELECT query_id FROM q)) b ON v.query_id = b.query_id AND v.chunk_id = b.chunk_id)
"""
SQL["rrf_fusion"] = FUSE + "SELECT query_id, chunk_id, round(similarity, 6) AS similarity, vec_rank, round(bm25_norm, 6) AS bm25_norm, fts_rank, round(rrf, 6) AS rrf FROM fu"
HYBRID = FUSE + f""", h1 AS (SELECT fu.*, d.file_path, d.text, {multiplier('d.file_path')} AS multiplier, {boost('query_text', 'd.text')} AS boost FROM fu JOIN d USING (chunk_id) JOIN q USING (query_id)),
h2 AS (SELECT *, (0.4 * coalesce(vec_similarity, 0) + 0.3 * coalesce(bm25_norm, 0) + 0.3 * rrf) * multiplier * boost AS base, count(*) OVER (PARTITION BY query_id, file_path) AS in_file FROM h1),
h3 AS (SELECT *, base * least(1 + 0.1 * (in_file - 1), 1.5) AS score FROM h2),
h4 AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_rank IS NULL, coalesce(vec_rank, fts_rank)) AS INTEGER) AS rank FROM h3 WHERE similarity >= 0.05 OR (similarity = 0 AND score > 0))
"""
SQL["hybrid_search"] = HYBRID + "SELECT query_id, rank, chunk_id, file_path, 1 AS start_line, CAST(len(string_split(text, chr(10))) AS INTEGER) AS end_line, round(similarity, 6) AS similarity, round(score, 6) AS score FROM h4 WHERE rank <= 10"
SQL["hybrid_debug"] = HYBRID + "SELECT query_id, rank, chunk_id, vec_rank, fts_rank, CAST(multiplier AS DOUBLE) AS multiplier, CAST(boost AS DOUBLE) AS boost, in_file FROM h4 WHERE rank <= 10"
SQL["merged_hits"] = """
WITH h AS (SELECT DISTINCT l_suppkey % 7 AS query_id, 'f' || (l_partkey % 50) AS file_path, CAST((l_orderkey * 13) % 4000 + 1 AS INTEGER) AS start_line,
  CAST((l_orderkey * 13) % 4000 + 1 + l_linenumber AS INTEGER) AS end_line, l_discount * 10 AS similarity, l_tax AS score, l_shipdate FROM lineitem),
m AS (SELECT *, max(end_line) OVER (PARTITION BY query_id, file_path ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM h),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_line > reach + 5 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, file_path ORDER BY start_line, end_line) AS island FROM m)
SELECT query_id, file_path, min(start_line) AS start_line, max(end_line) AS end_line, max(similarity) AS similarity, max(score) AS score, count(*) AS merged FROM i GROUP BY query_id, file_path, island
"""

# Text -----------------------------------------------------------------------

STOP = words(V.STOP_WORDS)
CAMEL = "string_split(regexp_replace(regexp_replace({w}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), ' ')"
SENT = values(X.SENTENCES, "t", "id", "text")


def camel(w: str) -> str:
    return CAMEL.replace("{w}", w)


SQL["identifier_split"] = f"""
WITH {SENT}, w AS (SELECT id, unnest(list_distinct_ordered) AS word, generate_subscripts(list_distinct_ordered, 1) AS n FROM
  (SELECT id, list_filter(ids, lambda x, i: list_position(ids, x) = i) AS list_distinct_ordered FROM (SELECT id, regexp_extract_all(text, '[a-zA-Z_$][a-zA-Z0-9_$]+') AS ids FROM t))),
k AS (SELECT id, n, list_concat([word], CASE WHEN regexp_matches(word, '[a-z][A-Z]') THEN {camel('word')} ELSE [] END,
  CASE WHEN contains(word, '_') THEN list_filter(string_split(word, '_'), lambda x: x <> '') ELSE [] END) AS parts FROM w
  WHERE (regexp_matches(word, '[a-z][A-Z]') OR contains(word, '_')) AND NOT (lower(word) IN {STOP} AND length(word) < 6))
SELECT t.id, coalesce(string_agg(array_to_string(parts, ' '), ' ' ORDER BY n), '') AS identifiers FROM t LEFT JOIN k USING (id) GROUP BY t.id
"""
SYN = values([(k, v) for k, v in V.SYNONYMS.items()], "syn", "word", "others")
KEEP = f"list_filter({{x}}, lambda p: length(p) > 1 AND NOT (lower(p) IN {STOP}))"
SQL["fts_query_compile"] = f"""
WITH {SENT}, {SYN}, k AS (SELECT id, text, list_filter(string_split(regexp_replace(text, '[^A-Za-z0-9_]+', ' ', 'g'), ' '), lambda x: x <> '' AND NOT (lower(x) IN {STOP})) AS tokens FROM t),
e AS (SELECT id, unnest(tokens) AS w, generate_subscripts(tokens, 1) AS n FROM k),
p AS (SELECT id, n, list_concat([w], CASE WHEN regexp_matches(w, '[a-z][A-Z]') THEN {KEEP.replace('{x}', camel('w'))} ELSE [] END,
  CASE WHEN contains(w, '_') THEN {KEEP.replace('{x}', "string_split(w, '_')")} ELSE [] END, coalesce(others, [])) AS parts FROM e LEFT JOIN syn ON word = lower(w)),
a AS (SELECT id, flatten(list(parts ORDER BY n)) AS phrases FROM p GROUP BY id)
SELECT k.id, CASE WHEN len(tokens) >= 3 THEN array_to_string(list_filter(tokens, lambda x, i: list_position(tokens, x) = i), '|') END AS all_phrases,
  array_to_string(list_filter(phrases, lambda x, i: list_position(phrases, x) = i), '|') AS any_phrases FROM k LEFT JOIN a USING (id)
"""
SQL["identifier_boost"] = f"WITH {SENT} SELECT a.id, b.id AS other, {boost('a.text', 'b.text')} AS boost FROM t a JOIN t b ON abs(a.id - b.id) <= 1"
PATHS = values(X.PATHS, "f", "file_path", "size")
SQL["file_type_multiplier"] = f"WITH {PATHS} SELECT file_path, CAST({multiplier('file_path')} AS DOUBLE) AS multiplier FROM f"
SQL["synonym_expand"] = f"WITH {SYN}, q AS (SELECT word FROM syn UNION ALL SELECT unnest(['AUTH', 'other'])) SELECT q.word, unnest(coalesce(others, [NULL])) AS synonym FROM q LEFT JOIN syn ON syn.word = lower(q.word)"
LANG = values(list(V.LANGUAGES.items()), "lang", "ext", "language")
EXT = "regexp_extract(lower({p}), '(\\.[a-z]+)$', 1)"
SQL["language_of"] = f"WITH {PATHS}, {LANG} SELECT file_path, language FROM f LEFT JOIN lang ON ext = {EXT.format(p='file_path')}"
CODE = values(X.CODE, "code", "file_path", "content")


def clean(text: str) -> str:
    for pattern, to in V.NOISE:
        text = f"regexp_replace({text}, {lit(pattern)}, {lit(to.replace('$1', chr(92) + '1'))}, 'g')"
    return text


SQL["strip_noise"] = f"WITH {CODE} SELECT file_path, {clean('content')} AS clean FROM code"
NOT_REF = words(V.NOT_A_REFERENCE)


def _definition(what: str) -> str:
    out = "CASE language"
    for lang, patterns in V.DEFINITIONS.items():
        tries = " ".join(
            f"WHEN regexp_extract(line, {lit(p)}, 1) <> '' AND NOT (regexp_extract(line, {lit(p)}, 1) IN {NOT_REF}) AND length(regexp_extract(line, {lit(p)}, 1)) > 1 THEN "
            + (lit(kind) if what == "kind" else f"regexp_extract(line, {lit(p)}, 1)")
            for p, kind in patterns
        )
        out += f" WHEN '{lang}' THEN CASE {tries} END"
    return out + " END"


DEFS = f"""WITH {CODE}, {LANG}, ln AS (SELECT file_path, language, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM code JOIN lang ON ext = {EXT.format(p='file_path')}),
df AS (SELECT file_path, n, {_definition('name')} AS name, {_definition('kind')} AS kind FROM ln WHERE trim(line, ' ' || chr(9)) <> '' AND NOT starts_with(trim(line, ' ' || chr(9)), '//') AND NOT starts_with(trim(line, ' ' || chr(9)), '*')),
defs AS (SELECT file_path, name, kind, CAST(min(n) AS INTEGER) AS line FROM df WHERE name IS NOT NULL GROUP BY ALL)"""
SQL["extract_definitions"] = DEFS + " SELECT file_path, name, kind, line FROM defs"
REFS = DEFS + f""", cl AS (SELECT file_path, {clean('content')} AS x FROM code),
im AS (SELECT file_path, trim(regexp_extract(trim(unnest(string_split(part, ','))), '^(.*?)(\\s+as\\s+.*)?$', 1)) AS name FROM (SELECT file_path, unnest(regexp_extract_all(x, {lit(V.IMPORTED)}, 1)) AS part FROM cl)),
rf AS (SELECT file_path, unnest(regexp_extract_all(x, {lit(V.CALL)}, 1)) AS name, TRUE AS checked FROM cl UNION ALL SELECT file_path, unnest(regexp_extract_all(x, {lit(V.MEMBER_CALL)}, 1)), TRUE FROM cl
  UNION ALL SELECT file_path, name, TRUE FROM im WHERE length(name) > 2 UNION ALL SELECT file_path, unnest(regexp_extract_all(x, {lit(V.CONSTRUCTED)}, 1)), FALSE FROM cl),
refs AS (SELECT DISTINCT file_path, name FROM rf WHERE NOT (checked AND name IN {NOT_REF}) AND (file_path, name) NOT IN (SELECT (file_path, name) FROM defs))"""
SQL["extract_references"] = REFS + " SELECT file_path, name FROM refs"

# Lookups and graph ----------------------------------------------------------

DOC_DEFS = f"""dl AS (SELECT {DOC_PATH} AS file_path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
dd AS (SELECT file_path, regexp_extract(lower(line), '^([a-z]+)', 1) AS name, CAST(n AS INTEGER) AS n FROM dl WHERE regexp_extract(lower(line), '^([a-z]+)', 1) <> '')"""
SQL["find_symbol"] = f"WITH {DOC_DEFS} SELECT file_path, 'word' AS kind, n AS line FROM dd WHERE name = 'the'"
SQL["find_references"] = REFS + " SELECT DISTINCT 'defined_in' AS relation, file_path FROM defs WHERE name = 'signIn' UNION ALL SELECT 'referenced_by', file_path FROM refs WHERE name = 'signIn'"
SQL["outline"] = DEFS + " SELECT name, kind, line FROM defs WHERE file_path = 'src/auth.ts'"
SQL["files_defining"] = f"WITH {DOC_DEFS} SELECT DISTINCT file_path FROM dd WHERE name IN ('the', 'thing', 'and', 'nowhere')"
SQL["path_fragment"] = f"WITH {DOC_DEFS} SELECT DISTINCT file_path FROM dd WHERE contains(lower(file_path), 'c1/en/1') ORDER BY file_path LIMIT 20"


def edges(most: int = 0) -> str:
    cut = f"WHERE n <= {most}" if most else ""
    return f"""{DOC_DEFS}, df AS (SELECT DISTINCT name, file_path AS dst FROM dd), nn AS (SELECT name, count(*) AS n FROM df GROUP BY name),
rf AS (SELECT DISTINCT {DOC_PATH} AS src, unnest(regexp_extract_all(lower(text), '\\p{{L}}{{5,}}')) AS name FROM documents),
eg AS MATERIALIZED (SELECT src, dst, sum(1.0::DOUBLE / n) AS w FROM rf JOIN df USING (name) JOIN (SELECT * FROM nn {cut}) USING (name) WHERE src <> dst GROUP BY src, dst)"""


def file_graph(weight: str, most: int = 0) -> str:
    return f"WITH {edges(most)} SELECT src, dst, round({weight}, 6) AS weight FROM eg"


SQL["file_graph_raw"] = file_graph("w")
SQL["file_graph_binary"] = file_graph("1.0::DOUBLE")
SQL["file_graph_sqrt"] = file_graph("sqrt(w)")
SQL["file_graph_max_definers"] = file_graph("w", 5)

# Steps of the walk from ``seed`` (query_id, node, score). A query keeps its ranks once a step has changed them by less than the tolerance.
WALK = f""", {edges()},
sh AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM eg),
re AS MATERIALIZED (SELECT query_id, node, score / sum(score) OVER (PARTITION BY query_id) AS p FROM seed),
r0 AS MATERIALIZED (SELECT query_id, node, p AS r FROM re),
l0 AS MATERIALIZED (SELECT DISTINCT query_id FROM re)""" + "".join(
    f""",
s{i} AS MATERIALIZED (SELECT query_id, node, sum(r) AS r FROM (
  SELECT query_id, dst AS node, {V.PPR_ALPHA} * r * share AS r FROM r{i - 1} JOIN sh ON node = src WHERE query_id IN (FROM l{i - 1})
  UNION ALL SELECT query_id, node, p * ({1 - V.PPR_ALPHA} + {V.PPR_ALPHA} * coalesce(lost, 0)) FROM re
    LEFT JOIN (SELECT query_id, sum(r) AS lost FROM r{i - 1} WHERE node NOT IN (SELECT src FROM sh) GROUP BY query_id) USING (query_id) WHERE query_id IN (FROM l{i - 1})) GROUP BY query_id, node),
r{i} AS MATERIALIZED (SELECT * FROM s{i} UNION ALL SELECT * FROM r{i - 1} WHERE query_id NOT IN (FROM l{i - 1})),
l{i} AS MATERIALIZED (SELECT query_id FROM (SELECT query_id, node, sum(r) AS d FROM (SELECT * FROM s{i} UNION ALL SELECT query_id, node, -r FROM r{i - 1} WHERE query_id IN (FROM l{i - 1})) GROUP BY ALL)
  GROUP BY query_id HAVING sum(abs(d)) >= {V.PPR_TOLERANCE})"""
    for i in range(1, V.PPR_ITERATIONS + 1)
) + f", ppr AS (SELECT query_id, node, r / max(r) OVER (PARTITION BY query_id) AS ppr FROM r{V.PPR_ITERATIONS} WHERE r > 0)"


def best_files(hits: str) -> str:
    """seed: the five best files of each query among hits (query_id, file_path, score)."""
    return f""", seed AS MATERIALIZED (SELECT query_id, file_path AS node, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, file_path) AS nth
  FROM (SELECT query_id, file_path, max(CAST(score AS DOUBLE)) AS score FROM {hits} GROUP BY ALL)) WHERE nth <= {V.DEFAULTS["search"]["hybrid"]["graph_seeds"]} AND score > 0)"""


PPR = LEXICAL + best_files("(FROM z WHERE rank <= 10)") + WALK
SQL["ppr"] = PPR + " SELECT query_id, node, round(ppr, 4) AS ppr FROM ppr"
SQL["graph_expand"] = PPR + """, x AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(ppr, 9) DESC, node) AS INTEGER) AS nth FROM ppr WHERE ppr >= 0.05 AND (query_id, node) NOT IN (SELECT (query_id, node) FROM seed))
SELECT query_id, node, nth, round(ppr, 4) AS ppr FROM x WHERE nth <= 3"""
# Hybrid search with the graph: candidates boosted by the rank of their file, and the best chunk of files that only the graph reaches (a file is a chunk here).
SQL["hybrid_graph"] = HYBRID.split("h2 AS")[0].rstrip().rstrip(",") + """, h2 AS (SELECT *, (0.4 * coalesce(vec_similarity, 0) + 0.3 * coalesce(bm25_norm, 0) + 0.3 * rrf) * multiplier * boost AS base FROM h1)""" + best_files("(SELECT query_id, file_path, base AS score FROM h2)") + WALK + f""",
g1 AS (SELECT h2.query_id, chunk_id, file_path, text, similarity, vec_rank, fts_rank, base * (1 + coalesce(ppr, 0)) AS base, FALSE AS via, NULL AS nth FROM h2 LEFT JOIN ppr ON ppr.query_id = h2.query_id AND node = file_path),
g2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(ppr, 9) DESC, node) AS nth FROM ppr WHERE ppr >= 0.05 AND (query_id, node) NOT IN (SELECT (query_id, file_path) FROM h2)),
g3 AS (SELECT g2.query_id, chunk_id, file_path, text, coalesce(list_cosine_similarity(CAST(embedding AS DOUBLE[]), w), 0) AS similarity, query_text, ppr, nth FROM g2 JOIN d ON file_path = node LEFT JOIN embeddings ON vec_id = chunk_id JOIN q ON q.query_id = g2.query_id WHERE nth <= 3),
g4 AS (SELECT * FROM g1 UNION ALL SELECT query_id, chunk_id, file_path, text, similarity, NULL, NULL, 0.4 * similarity * {multiplier('file_path')} * {boost('query_text', 'text')} * (1 + ppr), TRUE, nth FROM g3),
g5 AS (SELECT *, base * least(1 + 0.1 * (count(*) OVER (PARTITION BY query_id, file_path) - 1), 1.5) AS score FROM g4),
g6 AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, CASE WHEN via THEN 2 WHEN vec_rank IS NULL THEN 1 ELSE 0 END, coalesce(nth, vec_rank, fts_rank)) AS INTEGER) AS rank FROM g5 WHERE via OR similarity >= 0.05 OR (similarity = 0 AND score > 0))
SELECT query_id, rank, chunk_id, file_path, 1 AS start_line, CAST(len(string_split(text, chr(10))) AS INTEGER) AS end_line, round(similarity, 6) AS similarity, round(score, 6) AS score FROM g6 WHERE rank <= 10"""

# Chunks ---------------------------------------------------------------------

# Prefix sums of line lengths give each chunk's end and the next one's start.
SQL["chunk_fixed"] = f"""
WITH RECURSIVE d AS (SELECT {DOC_PATH} AS file_path, string_split(text, chr(10)) AS lines FROM documents),
p AS (SELECT file_path, lines, len(lines) AS n, list_prepend(0, list_transform(range(1, len(lines) + 1), lambda i: list_sum(list_transform(lines[1:i], lambda x: length(x) + 1)))) AS ps FROM d),
r AS (SELECT file_path, 0 AS k, 1 AS s, list_filter(range(1, n + 1), lambda i: ps[i + 1] >= 256)[1] AS e FROM p
  UNION ALL SELECT file_path, k + 1, s2, list_filter(range(e + 1, n + 1), lambda i: ps[i + 1] - ps[s2] >= 256)[1] FROM
    (SELECT r.file_path, k, e, n, ps, greatest(s, coalesce(list_max(list_filter(range(1, e + 1), lambda j: ps[e + 1] - ps[j] >= 32)), s)) AS s2 FROM r JOIN p USING (file_path) WHERE e IS NOT NULL))
SELECT file_path, CAST(k AS INTEGER) AS chunk_index, CAST(s AS INTEGER) AS start_line, CAST(coalesce(e, n) AS INTEGER) AS end_line, md5(array_to_string(lines[s:coalesce(e, n)], chr(10))) AS md5 FROM r JOIN p USING (file_path)
"""
BOUND = "CASE regexp_extract(regexp_extract(file_path, '([^/]*)$', 1), '^.+?(\\.[^.]*)$', 1) " + " ".join(f"WHEN '{e}' THEN regexp_matches(line, {lit(p)})" for e, p in V.BOUNDARIES.items()) + " ELSE FALSE END"
PREAMBLE = f"""WITH {CODE}, ln AS (SELECT file_path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM code),
c AS (SELECT *, {BOUND} AS boundary, regexp_matches(line, {lit(V.COMMENT_LINE)}) AS comment FROM ln),
s AS (SELECT *, NOT comment AND NOT (trim(line, ' ' || chr(9)) = '' AND coalesce(lag(comment) OVER (PARTITION BY file_path ORDER BY n), FALSE)) AS stop FROM c),
b AS (SELECT *, coalesce(max(CASE WHEN stop THEN n END) OVER (PARTITION BY file_path ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS start FROM s)"""


def fixed(pieces: str, most: int, overlap: int) -> str:
    """CTEs from pieces (file_path, piece, base, lines) to cut (file_path, piece, k, s, e), lines of the file: chunks of ``most`` characters. Piece by piece as in chunk_fixed."""
    return f"""
fp AS (SELECT file_path, piece, base, lines, len(lines) AS n, list_prepend(0, list_transform(range(1, len(lines) + 1), lambda i: list_sum(list_transform(lines[1:i], lambda x: length(x) + 1)))) AS ps FROM {pieces}),
fr AS (SELECT file_path, piece, 0 AS k, 1 AS s, list_filter(range(1, n + 1), lambda i: ps[i + 1] >= {most})[1] AS e FROM fp
  UNION ALL SELECT file_path, piece, k + 1, s2, list_filter(range(e + 1, n + 1), lambda i: ps[i + 1] - ps[s2] >= {most})[1] FROM
    (SELECT fr.file_path, fr.piece, k, e, n, ps, greatest(s, coalesce(list_max(list_filter(range(1, e + 1), lambda j: ps[e + 1] - ps[j] >= {overlap})), s)) AS s2 FROM fr JOIN fp USING (file_path, piece) WHERE e IS NOT NULL)),
cut AS (SELECT file_path, piece, k, base + s - 1 AS s, base + coalesce(e, n) - 1 AS e FROM fr JOIN fp USING (file_path, piece))"""


# Chunks at declarations where a file has two, else of fixed size; hybrid also divides those above the size.
SYNTAX = PREAMBLE.replace("WITH ", "WITH RECURSIVE ", 1) + """,
al AS (SELECT file_path, string_split(content, chr(10)) AS lines FROM code),
bs AS (SELECT file_path, list(start ORDER BY start) AS s FROM b WHERE boundary GROUP BY file_path HAVING count(*) >= 2),
ra AS (SELECT file_path, lines, unnest(range(0, len(s) + 1)) AS i, s FROM bs JOIN al USING (file_path)),
rb AS (SELECT file_path, lines, i, CASE WHEN i = 0 THEN 1 ELSE s[i] END AS first, CASE WHEN i < len(s) THEN s[i + 1] - 1 ELSE len(lines) END AS last FROM ra),
sy AS (SELECT file_path, lines, i AS piece, CAST(first AS BIGINT) AS base, CAST(last AS BIGINT) AS last FROM rb WHERE last >= first AND (i > 0 OR regexp_matches(array_to_string(lines[first:last], ''), '\\S')))"""


def chunked(strategy: str, most: int, overlap: int) -> str:
    rest = "SELECT file_path, 0::BIGINT AS piece, 1::BIGINT AS base, lines FROM al WHERE file_path NOT IN (SELECT file_path FROM bs)"
    own = "lines[base:last]"
    whole = "TRUE" if strategy == "syntax" else f"length(array_to_string({own}, chr(10))) <= {most}"
    return SYNTAX + f""", pc AS ({rest} UNION ALL SELECT file_path, piece, base, {own} FROM sy WHERE NOT ({whole})), {fixed('pc', most, overlap)},
ch AS (SELECT file_path, piece, k, s, e FROM cut UNION ALL SELECT file_path, piece, 0, base, last FROM sy WHERE {whole})
SELECT file_path, CAST(row_number() OVER (PARTITION BY file_path ORDER BY piece, k) - 1 AS INTEGER) AS chunk_index, CAST(s AS INTEGER) AS start_line, CAST(e AS INTEGER) AS end_line, md5(array_to_string(lines[s:e], chr(10))) AS md5 FROM ch JOIN al USING (file_path)"""


SQL["chunk_syntax"] = chunked("syntax", 2048, 200)
SQL["chunk_hybrid"] = chunked("hybrid", 80, 16)
SQL["preamble_claim"] = PREAMBLE + " SELECT file_path, CAST(n AS INTEGER) AS n, CAST(start AS INTEGER) AS start FROM b WHERE boundary"

# Index ----------------------------------------------------------------------

LINES = f"WITH f AS (SELECT doc_id, {DOC_PATH} AS file_path, text AS content FROM documents), c AS (SELECT doc_id, file_path, CAST(generate_subscripts(string_split(content, chr(10)), 1) - 1 AS INTEGER) AS chunk_index, unnest(string_split(content, chr(10))) AS chunk_text FROM f)"
SQL["index_stats"] = LINES + " SELECT count(DISTINCT file_path) AS files, count(*) AS chunks FROM c"
SQL["file_stats"] = LINES + " SELECT file_path, count(*) AS chunks, max(doc_id * 60 + chunk_index) AS last_updated FROM c GROUP BY file_path"
SQL["ext_counts"] = LINES + " SELECT '.' || split_part(file_path, '.', -1) AS ext, count(DISTINCT file_path) AS files FROM f GROUP BY 1"
SQL["ext_grid"] = LINES + " SELECT '.' || split_part(file_path, '.', -1) AS ext, count(*) AS files, CAST(floor(count(*)::DOUBLE / (SELECT count(*) FROM f) * 20 + 0.5) AS INTEGER) AS cells FROM f GROUP BY 1"
SQL["mean_chunks"] = LINES + " SELECT floor(count(*)::DOUBLE / count(DISTINCT file_path) * 10 + 0.5) / 10 AS mean_chunks FROM c"
SQL["coverage"] = LINES + """ SELECT i AS indexed, e AS eligible, CAST(floor(100.0 * i / e + 0.5) AS INTEGER) AS percent, floor(100.0 * i / e + 0.5) < 75 AS low
 FROM (SELECT count(DISTINCT file_path) AS i FROM c WHERE doc_id % 3 <> 0), (SELECT count(DISTINCT file_path) AS e FROM f)"""
SQL["health"] = LINES + " SELECT count(*) > 0 AS ok, count(DISTINCT file_path) AS files, count(*) AS chunks, 'idle' AS status, FALSE AS dimension_mismatch FROM c"
SQL["sync_progress"] = """SELECT event_id, CASE WHEN event_id % 7 > 0 THEN CAST(floor(100.0 * (user_id % 50) / (event_id % 7 * 10) + 0.5) AS INTEGER) END AS percent,
 event_id % 2 = 0 AND (event_id % 600 - 100 > 300 OR event_id % 600 - 100 < 0) AS stale FROM events"""
AGE = "p_partkey * 97"
SQL["shown_sizes"] = f"""SELECT p_partkey, CASE WHEN {AGE} < 60 THEN 'just now' WHEN {AGE} < 3600 THEN ({AGE} // 60) || ' minute' || CASE WHEN {AGE} // 60 = 1 THEN '' ELSE 's' END || ' ago'
 WHEN {AGE} < 86400 THEN ({AGE} // 3600) || ' hour' || CASE WHEN {AGE} // 3600 = 1 THEN '' ELSE 's' END || ' ago' ELSE 'about ' || ({AGE} // 86400) || ' day' || CASE WHEN {AGE} // 86400 = 1 THEN '' ELSE 's' END || ' ago' END AS age,
 CASE WHEN {AGE} < 60 THEN '~now' WHEN {AGE} < 3600 THEN '~' || ({AGE} // 60) || 'm' WHEN {AGE} < 86400 THEN '~' || ({AGE} // 3600) || 'h' ELSE '~' || ({AGE} // 86400) || 'd' END AS short_age FROM part"""
SNAP = f"""WITH f AS (SELECT doc_id, {DOC_PATH} AS file_path, text FROM documents), o AS (SELECT file_path, CASE WHEN doc_id % 7 = 0 THEN md5(text || '!') ELSE md5(text) END AS h FROM f WHERE doc_id % 5 <> 0),
n AS (SELECT file_path, md5(text) AS h FROM f WHERE doc_id % 11 <> 0)"""
SQL["diff_files"] = SNAP + " SELECT coalesce(o.file_path, n.file_path) AS file_path, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'deleted' WHEN o.h = n.h THEN 'unchanged' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.file_path = n.file_path"
SQL["gc_orphans"] = LINES + " SELECT file_path, chunk_index FROM c WHERE NOT (doc_id % 5 <> 0 AND doc_id % 11 = 0)"
SQL["upsert_chunks"] = LINES + """ SELECT file_path, chunk_index, md5(chunk_text) AS file_hash, 'old' AS version FROM c WHERE doc_id % 2 = 0 AND doc_id % 3 <> 0
 UNION ALL SELECT file_path, chunk_index, md5(chunk_text || '!'), 'new' FROM c WHERE doc_id % 3 = 0"""
SQL["orphan_chunks"] = LINES + " SELECT file_path, chunk_index FROM c WHERE doc_id % 2 <> 0 OR chunk_index <= doc_id % 6"
SQL["embedded_documents"] = "SELECT doc_id, 16 AS dimensions FROM documents"
SQL["stream_upsert"] = "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id"

# Predicates -----------------------------------------------------------------

SQL["eligible_files"] = f"""WITH {PATHS}, g AS (SELECT file_path, size, replace(file_path, chr(92), '/') AS p FROM f)
SELECT file_path, regexp_matches(p, '\\.(ts|tsx|js|jsx|py|go|rs|java|rb|php|sql|md)$') AND NOT regexp_matches('/' || p, '/\\.[^/]') AND NOT regexp_matches(p, '^(node_modules|dist|build|\\.next|docs)/')
 AND NOT regexp_matches(p, '^[^/]*\\.(lock|min\\.js)$') AND coalesce(size <= 512000, FALSE) AS eligible FROM g"""
SQL["acl_filter"] = f"""WITH {values(X.DIRECTORIES, 'd', 'path', 'allow', 'deny')}
SELECT path, len(list_filter(allow, lambda a: path = a OR starts_with(path, a || '/'))) = 0 AND (path IN ('/', '/home', '/home/ann') OR len(list_filter(deny, lambda a: path = a OR starts_with(path, a || '/'))) > 0) AS denied FROM d"""
SQL["route_query"] = f"""WITH {values(X.REQUESTS, 'q', 'id', 'pattern', 'path', 'output_mode', 'from_shell')}
SELECT id, CASE WHEN pattern IS NULL OR length(pattern) < 4 OR regexp_matches(pattern, {lit(V.METACHARACTERS)}) OR regexp_matches(pattern, '\\w\\.\\w') OR regexp_matches(pattern, '[/\\\\]')
  OR (path <> '' AND NOT suffix(path, '/') AND regexp_matches(path, '[^/]\\.[^/.]*$')) OR output_mode = 'count' OR (NOT from_shell AND output_mode = 'content')
  OR regexp_matches(pattern, '^["'']|["'']$') OR regexp_matches(pattern, {lit(V.MARKER)}) OR regexp_matches(pattern, {lit(V.URL_LIKE)})
  OR (path <> '' AND (regexp_matches(regexp_replace(path, '^\\./', ''), '^(node_modules|dist|build|\\.next)(/|$)') OR (regexp_matches(rtrim(path, '/'), '\\.[A-Za-z0-9]+$') AND NOT regexp_matches(rtrim(path, '/'), '\\.(ts|tsx|js|jsx|py|go|rs|java|rb|php|sql|md)$'))))
 THEN 'pass' WHEN regexp_matches(pattern, '^[A-Za-z_$][\\w$]*$') THEN 'find_symbol' ELSE 'search_code' END AS route FROM q"""
SQL["shell_pattern"] = f"""WITH {values(X.COMMANDS, 'c', 'id', 'command')}, a AS (SELECT id, CASE WHEN regexp_matches(command, {lit(V.SHELL_SEARCH)}) THEN regexp_extract(command, {lit(V.SHELL_SEARCH)}, 1) END AS args FROM c),
t AS (SELECT id, CASE WHEN NOT regexp_matches(args, {lit(V.SHELL_COUNTS)}) THEN list_transform(list_filter(regexp_extract_all(args, {lit(V.SHELL_TOKEN)}), lambda x: NOT starts_with(x, '-')), lambda x: regexp_replace(x, '^["'']|["'']$', '', 'g')) END AS w FROM a)
SELECT id, w[1] AS pattern, CASE WHEN w[1] IS NOT NULL THEN coalesce(w[2], '') END AS path FROM t"""
