"""DuckDB SQL of the queries that SQL can express on whole tables."""

from surveyspark.llm.pii import BASE, KINDS, LEAST_SCORE, Kind

WORDS = r"regexp_extract_all({x}, '[^\x20\x09-\x0D]+')"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, {WORDS.format(x="coalesce(text, '')")} AS w FROM documents),
win AS (SELECT d.doc_id, r.p, md5(array_to_string(d.w[r.p:r.p + 19], ' ')) AS h FROM d, range(1, len(d.w) - 18) AS r(p)),
later AS (SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS rn FROM win) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM later),
word AS (SELECT d.doc_id, r.i, d.w[r.i] AS x FROM d, range(1, len(d.w) + 1) AS r(i)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
cut AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(cut.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN cut USING (doc_id)"""

_COMPONENTS = """reach(a, b) AS (
  SELECT a, b FROM linked UNION SELECT b, a FROM linked
  UNION SELECT r.a, l.b FROM reach r JOIN (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked) l ON l.a = r.b),
root AS (SELECT a AS id, least(a, min(b)) AS root FROM reach GROUP BY a)"""

NGRAM_JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(x=f"coalesce({LOWER}, '')")} AS w FROM documents),
sh AS (SELECT DISTINCT d.doc_id, array_to_string(d.w[r.p:r.p + 4], ' ') AS s FROM d, range(1, greatest(len(d.w) - 3, 2)) AS r(p)
       WHERE len(d.w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_have AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
linked AS (SELECT a, b FROM both_have JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
{_COMPONENTS}
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(root.root, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN root ON root.id = d.doc_id"""

EMBEDDING_DEDUP = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
linked AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.95),
{_COMPONENTS},
n AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM linked UNION ALL SELECT b FROM linked) GROUP BY id)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(root.root, v.vec_id) AS component_id,
       coalesce(root.root, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN n ON n.id = v.vec_id LEFT JOIN root ON root.id = v.vec_id"""


def _escaped(x: str) -> str:
    marks = r"(<|\[)(/?s>|/?INST\]|/?SYS>|<SYS>>|</SYS>>|\|)"
    return rf"regexp_replace(replace({x}, '\', '\\'), '{marks}', '\1\\\2', 'g')"


CHAT_FORMAT = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 1, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 2, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, '<s>' || replace({_escaped('role')}, chr(10), '<\br>') || chr(10) || {_escaped('text')} || '</s>' AS piece FROM c),
g AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
             coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
             string_agg(piece, '' ORDER BY turn, role, text) AS formatted FROM f GROUP BY conv_id)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(length(formatted) AS BIGINT) AS formatted_chars FROM g"""

_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten([list_prepend(ascii(c)::BIGINT, [-1::BIGINT for i in range(8)])
  for c in string_split({x}, '')])), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) END))"""

PERIODIC_RUNS = f"""
WITH d0 AS (SELECT doc_id, {WORDS.format(x="coalesce(text, '')")} AS w, {_CRC32.format(x="CAST(doc_id AS VARCHAR)")} AS h FROM documents),
d1 AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d0),
d AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE [w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]
        for i in range(0, n)] END AS w FROM d1),
word AS (SELECT d.doc_id, d.n, r.i, d.w[r.i + 1] AS x FROM d, range(0, d.n) AS r(i)),
same AS (SELECT l.doc_id, r.i - l.i AS q, l.i FROM word l JOIN word r ON l.doc_id = r.doc_id AND l.x = r.x
         AND r.i > l.i AND 4 * (r.i - l.i) <= l.n),
isle AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM same),
stretch AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM isle GROUP BY doc_id, q, k
            HAVING count(*) + q >= greatest(6, 4 * q)),
run AS (SELECT doc_id, start, length, min(q) AS period FROM stretch GROUP BY doc_id, start, length),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t
           FROM run GROUP BY doc_id),
best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(listed.n_runs, 0) AS BIGINT) AS n_runs, CAST(best.start AS BIGINT) AS start,
       CAST(best.length AS BIGINT) AS length, CAST(best.period AS BIGINT) AS period,
       CAST(1000 * best.length // best.period AS BIGINT) AS exponent_milli,
       sha256(coalesce(listed.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)"""

_DIGITS = "regexp_replace(s, '[^0-9]', '', 'g')"
_COMPACT = "replace(s, ' ', '')"
_LUHN = """(SELECT list_sum([CASE WHEN (length(d) - i) % 2 = 1 THEN 2 * CAST(d[i] AS INT) // 10 + 2 * CAST(d[i] AS INT) % 10
  ELSE CAST(d[i] AS INT) END for i in range(1, length(d) + 1)]) % 10 = 0 FROM (SELECT """ + _DIGITS + """ AS d))"""
_MOD97 = """(SELECT list_reduce(list_prepend(0, [CASE WHEN x >= 'A' THEN ascii(x) - 55 ELSE ascii(x) - 48 END
  for x in string_split(c[5:] || c[:4], '')]), lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1
  FROM (SELECT """ + _COMPACT + """ AS c))"""


def _alone(beside: str = "A-Za-z0-9") -> str:
    return rf"NOT regexp_matches(before, '[{beside}]\z') AND NOT regexp_matches(after, '^[{beside}]')"


def _size(least: int, most: int) -> str:
    return f"length({_DIGITS}) BETWEEN {least} AND {most}"


_RUN = r"[0-9]([\x20-]?[0-9])+"
#: kind: plain pattern, what makes a match a proposal, what the proposal must pass
_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "true",
           "len([x for x in string_split(s, '.') if length(ltrim(x, '0')) > 3 OR CAST('0' || right(ltrim(x, '0'), 9) AS INT) > 255]) = 0"),
    "card": (_RUN, _size(16, 19), _LUHN),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "true", _size(8, 15)),
    "iban": (r"[A-Z][A-Z][0-9][0-9](?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", "true",
             f"length({_COMPACT}) BETWEEN 15 AND 34 AND {_alone()} AND {_MOD97}"),
    "short_card": (_RUN, _size(13, 15), f"{_LUHN} AND {_alone('A-Za-z0-9+.')}"),
    "local_phone": (r"[0-9(][0-9() /-]{5,17}[0-9]", "true", f"{_size(7, 12)} AND {_alone('A-Za-z0-9+.()/-')}"),
    "national_id": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "true",
                    f"NOT regexp_matches(s, '^(000|666|9)|-00-|0000') AND {_alone('A-Za-z0-9+.-')}"),
}


def _says(words: tuple[str, ...]) -> str:
    test = rf"(^|[^a-z])({'|'.join(words)})([^a-z]|\z)"
    low = [f"regexp_matches({LOWER.replace('text', x)}, '{test}')" for x in ("before", "after")]
    return f"CASE WHEN {' OR '.join(low)} THEN 0.3 ELSE 0 END" if words else "0"


def _kind_sql(place: int, kind: Kind) -> str:
    pattern, proposal, holds = _KINDS[kind.name]
    score = f"round({kind.prior} + {_says(kind.near)} - {_says(kind.far)}, 3)"
    return f"""
m{place} AS (SELECT doc_id, text, r.i, h[r.i] AS s, length(g[r.i]) + length(h[r.i]) AS n FROM (SELECT doc_id, text,
  regexp_extract_all(text, '{pattern}') AS h, string_split_regex(text, '{pattern}') AS g FROM d), range(1, len(h) + 1) AS r(i)),
p{place} AS (SELECT *, e - length(s) AS b FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM m{place}) WHERE {proposal}),
c{place} AS (SELECT doc_id, s, b, e, text[coalesce(lag(e) OVER w, 0) + 1:b][-48:] AS before,
  text[e + 1:coalesce(lead(b) OVER w, length(text))][:48] AS after FROM p{place} WINDOW w AS (PARTITION BY doc_id ORDER BY b)),
s{place} AS (SELECT doc_id, {place} AS k, b, '{kind.name}:' || CAST(b AS BIGINT) || ':' || CAST(e AS BIGINT) AS t
  FROM c{place} WHERE {holds}{"" if kind.base else f" AND {score} >= {LEAST_SCORE}"}),"""


PII = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),{"".join(_kind_sql(i, k) for i, k in enumerate(KINDS))}
span AS ({" UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(len(KINDS)))}),
g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (k = {i}) AS n_{k.name}" for i, k in enumerate(KINDS) if k.base)},
      string_agg(t, ',' ORDER BY k, b) FILTER (k < {len(BASE)}) AS base, string_agg(t, ',' ORDER BY k, b) AS spans FROM span GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}" for k in BASE)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""

ORACLE = {
    "op2_substring_dedup": SUBSTRING_DEDUP.strip(),
    "op3_embedding_dedup": EMBEDDING_DEDUP.strip(),
    "op4_chat_format": CHAT_FORMAT.strip(),
    "op8_ngram_jaccard": NGRAM_JACCARD.strip(),
    "op12_pii": PII.strip(),
    "op13_periodic_runs": PERIODIC_RUNS.strip(),
}
