"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from postloom.llm import privacy, secrets

_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+')"


def _shingles(table: str, key: str) -> str:
    return f"""
  SELECT DISTINCT {key}, array_to_string(w[i:i+4], ' ') AS s
  FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i
        FROM (SELECT {key}, {_WORDS} AS w FROM {table}) WHERE len(w) > 0)"""


CONTAINED = f"""
WITH d AS ({_shingles("documents", "doc_id")}),
b AS ({_shingles("benchmark", "item_id")}),
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id)
SELECT doc_id, b.item_id, n_item, count(*) AS n_found, CAST(count(*) AS DOUBLE) / n_item AS containment
FROM d JOIN b USING (s) JOIN n USING (item_id)
GROUP BY doc_id, b.item_id, n_item HAVING CAST(count(*) AS DOUBLE) / n_item >= 0.8
"""

SIMILAR = f"""
WITH RECURSIVE d AS ({_shingles("documents", "doc_id")}),
n AS (SELECT doc_id, count(*) AS n, string_agg(s, '|' ORDER BY s) AS whole FROM d GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM d a JOIN d b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (
  SELECT x, y, nx.whole AS wx, ny.whole AS wy
  FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE CAST(c AS DOUBLE) / (nx.n + ny.n - c) >= 0.8),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
least_id AS (SELECT x, least(x, min(y)) AS class_id FROM r GROUP BY x),
links AS (SELECT x, count(*) AS n_links, count(DISTINCT CASE WHEN wx <> wy THEN wy END) AS texts FROM l GROUP BY x),
copies AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY whole) AS copy_id, count(*) OVER (PARTITION BY whole) AS k FROM n)
SELECT o.doc_id, coalesce(class_id, o.doc_id) AS class_id, coalesce(copy_id, o.doc_id) AS copy_id,
       coalesce(k, 1) AS n_copies, coalesce(n_links, 0) AS n_links, coalesce(texts, 0) AS n_linked_texts
FROM documents o LEFT JOIN least_id li ON li.x = o.doc_id LEFT JOIN links k ON k.x = o.doc_id
LEFT JOIN copies c ON c.doc_id = o.doc_id
"""

EXACT = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h)
"""

MIX = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         sha256('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk
  FROM d GROUP BY source),
w AS (
  SELECT *, CASE rk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
r AS (
  SELECT *, CAST(source_size * 3 AS DOUBLE) / weight AS ratio FROM w),
l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER before, 0) AS DOUBLE)
            / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS lev
  FROM r WINDOW before AS (ORDER BY ratio, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT arg_min(lev, (ratio, rk)) AS mark FROM l WHERE lev <= ratio),
t AS (
  SELECT source, rk, source_size, least(CAST(source_size * 3 AS DOUBLE), mark * weight) AS target
  FROM l, lv),
c AS (
  SELECT d.doc_id, d.size, d.k, t.rk, t.source_size, t.target,
         sum(d.size) OVER (PARTITION BY t.rk ORDER BY d.k, d.doc_id, d.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (
  SELECT c.*, copy, CAST(source_size * copy + cum AS DOUBLE) / target AS finish
  FROM c, (VALUES (0), (1), (2)) AS v(copy) WHERE target > 0),
q AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rk, k, doc_id, size, copy ROWS UNBOUNDED PRECEDING) AS words FROM p),
x AS (
  SELECT doc_id, rk, count(*) AS n FROM q
  WHERE words <= (SELECT sum(size) FROM d) GROUP BY doc_id, rk)
SELECT c.doc_id, CAST(c.size AS BIGINT) AS size, c.source_size, c.target,
       CAST(c.size * coalesce(x.n, 0) AS BIGINT) AS taken
FROM c LEFT JOIN x ON x.doc_id IS NOT DISTINCT FROM c.doc_id AND x.rk = c.rk
"""


# Matches with their places: a mark around each, cut at the marks, lengths added up.
_PIECES = "string_split(regexp_replace({text}, '{pattern}', chr(65535) || '\\0' || chr(65535), 'g'), chr(65535))"


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def _placed(pieces: str) -> str:
    return f"""list_transform(range(2, len({pieces}) + 1, 2), lambda i: {{
      'a': CAST(coalesce(list_sum(list_transform({pieces}[1:i - 1], lambda x: length(x))), 0) AS BIGINT),
      'b': CAST(list_sum(list_transform({pieces}[1:i], lambda x: length(x))) AS BIGINT),
      'v': {pieces}[i], 'l': {pieces}[i - 1], 'r': {pieces}[i + 1]}})"""


def _kind(spans: str, order: int, kind: str) -> str:
    return f"list_transform({spans}, lambda s: {{'a': s.a, 'o': {order}, 'b': s.b, 'k': '{kind}'}})"


def _joined(spans: str) -> str:
    return f"array_to_string(list_transform({spans}, lambda s: s.k || ':' || s.a || ':' || s.b), ',')"


def _of_kind(kind: str) -> str:
    return f"len(list_filter(base, lambda s: s.k = '{kind}')) AS n_{kind}"


_TEXTS = "SELECT doc_id, replace(coalesce(text, ''), chr(65535), chr(65534)) AS t FROM documents"


def _secrets() -> str:
    kinds = {"assign": secrets.ASSIGN, "access": secrets.ACCESS, "hex": secrets.HEX, "candidate": secrets.CANDIDATE}
    cut = ", ".join(f"{_PIECES.format(text='t', pattern=_quoted(p))} AS p_{k}" for k, p in kinds.items())
    placed = ", ".join(f"{_placed(f'p_{k}')} AS {k}" for k in kinds)
    value = f"regexp_extract(s.v, '{_quoted(secrets.ASSIGN)}', 2)"
    k = len(secrets.ALPHABET)
    code = f"strpos('{secrets.ALPHABET}', substr({{0}}, {{1}}, 1))"
    steps = f"{code.format('sample', 'i')} AS a, {code.format('sample', 'i + 1')} AS b"
    return f"""
WITH p AS MATERIALIZED (SELECT doc_id, {cut} FROM ({_TEXTS})),
q AS MATERIALIZED (SELECT doc_id, {placed} FROM p),
m AS (SELECT * REPLACE (list_filter(assign, lambda s: length({value}) >= {secrets.MIN_VALUE}) AS assign) FROM q),
f AS MATERIALIZED (
  SELECT *, list_sort(list_concat(list_concat({_kind("assign", 0, "assign")}, {_kind("access", 1, "access")}),
                                  {_kind("hex", 2, "hex")})) AS base FROM m),
c AS MATERIALIZED (
  SELECT *, list_filter(candidate, lambda c: len(list_filter(base, lambda o: c.a < o.b AND c.b > o.a)) = 0) AS free FROM f),
samples AS (
  SELECT {value} AS sample, 1 AS secret FROM (SELECT unnest(assign) AS s FROM c)
  UNION ALL SELECT s.v, 1 FROM (SELECT unnest(list_concat(access, hex)) AS s FROM c)
  UNION ALL SELECT s.v, 0 FROM (SELECT unnest(free) AS s FROM c) WHERE regexp_matches(s.v, '{secrets.ORDINARY}')),
steps AS (
  SELECT secret, {steps} FROM (SELECT sample, secret, unnest(range(1, length(sample))) AS i FROM samples)),
n AS (SELECT secret, a, b, count(*) AS n FROM steps WHERE a > 0 AND b > 0 GROUP BY ALL),
both_labels AS (SELECT 0 AS secret UNION ALL SELECT 1),
cells AS (SELECT secret, x.i AS a, y.i AS b FROM both_labels, range(1, {k + 1}) x(i), range(1, {k + 1}) y(i)),
counted AS (SELECT cells.*, coalesce(n.n, 0) AS n FROM cells LEFT JOIN n USING (secret, a, b)),
shares AS (
  SELECT *, CAST(sum(n) OVER (PARTITION BY secret, a) AS BIGINT) AS in_row,
         CAST(sum(n) OVER (PARTITION BY secret, b) + 1 AS DOUBLE)
           / CAST(sum(n) OVER (PARTITION BY secret) + {k} AS DOUBLE) AS share
  FROM counted),
ratios AS (
  SELECT a, b, CAST(round({secrets.SCALE} * ln(max(p) FILTER (secret = 1) / max(p) FILTER (secret = 0))) AS BIGINT) AS r
  FROM (SELECT secret, a, b, (n + {secrets.BACK_OFF} * share) / (in_row + {secrets.BACK_OFF}) AS p FROM shares)
  WHERE (SELECT count(DISTINCT secret) FROM n) = 2 GROUP BY a, b),
scored AS (
  SELECT doc_id, s, sum(r) AS total
  FROM (SELECT doc_id, s, {code.format("s.v", "i")} AS a, {code.format("s.v", "i + 1")} AS b
        FROM (SELECT doc_id, s, unnest(range(1, length(s.v))) AS i FROM (SELECT doc_id, unnest(free) AS s FROM c)))
  JOIN ratios USING (a, b) GROUP BY doc_id, s),
random AS (
  SELECT doc_id, list({{'a': s.a, 'o': 3, 'b': s.b, 'k': 'random'}}) AS added FROM scored
  WHERE total >= {secrets.MIN_RATIO * secrets.SCALE} * (length(s.v) - 1) GROUP BY doc_id)
SELECT doc_id, {", ".join(map(_of_kind, secrets.KINDS))}, coalesce(len(added), 0) AS n_random,
       sha256({_joined("base")}) AS base_sha256,
       {_joined("list_sort(list_concat(base, coalesce(added, [])))")} AS spans
FROM c LEFT JOIN random USING (doc_id)
"""


# The base patterns as they are stated, for SQL's regular expressions.
_PRIVATE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_DIGITS = "regexp_replace(s.v, '[^0-9]', '', 'g')"
_VALID = {
    "email": "true",
    "ip": "len(list_filter(string_split(s.v, '.'), lambda x: coalesce(TRY_CAST(x AS HUGEINT), 256) > 255)) = 0",
    "card": f"""length({_DIGITS}) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i:
        CASE WHEN (length({_DIGITS}) - i) % 2 = 0 THEN CAST(substr({_DIGITS}, i, 1) AS INT)
             ELSE CAST(substr({_DIGITS}, i, 1) AS INT) * 2 - 9 * CAST(CAST(substr({_DIGITS}, i, 1) AS INT) > 4 AS INT) END)) % 10 = 0""",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
}


def _private() -> str:
    cut = ", ".join(f"{_PIECES.format(text='t', pattern=p)} AS p_{k}" for k, p in _PRIVATE.items())
    placed = ", ".join(f"list_filter({_placed(f'p_{k}')}, lambda s: {_VALID[k]}) AS {k}" for k in _PRIVATE)
    mentions = " UNION ".join(
        f"SELECT doc_id, '{k}:' || lower(s.v) AS entity FROM (SELECT doc_id, unnest({k}) AS s FROM f)" for k in _PRIVATE
    )
    base = "[]"
    for i, k in enumerate(_PRIVATE):
        base = f"list_concat({base}, {_kind(k, i, k)})" if i else _kind(k, i, k)
    words = _PIECES.format(text="t", pattern=privacy.TERM)
    return f"""
WITH p AS MATERIALIZED (SELECT doc_id, {cut} FROM ({_TEXTS})),
q AS MATERIALIZED (SELECT doc_id, {placed} FROM p),
f AS MATERIALIZED (SELECT *, list_sort({base}) AS base FROM q),
mentions AS MATERIALIZED ({mentions}),
pieces AS MATERIALIZED (
  SELECT f.doc_id, t, base, {words} AS p_t FROM f JOIN ({_TEXTS}) USING (doc_id) WHERE len(base) > 0),
terms AS MATERIALIZED (
  SELECT * FROM (SELECT doc_id, t, base, w.a, w.b, lower(w.v) AS term FROM (SELECT doc_id, t, base, unnest({_placed("p_t")}) AS w FROM pieces)) x
  WHERE len(list_filter(base, lambda o: x.a < o.b AND x.b > o.a)) = 0),
docs_with AS (SELECT entity, count(*) AS n_entity FROM mentions GROUP BY entity),
words AS (
  SELECT term, count(*) AS n_term
  FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+'))) AS term FROM ({_TEXTS}))
  GROUP BY term),
pairs AS (
  SELECT entity, term, count(*) AS n_both
  FROM mentions JOIN (SELECT DISTINCT doc_id, md5(t) AS copy, term FROM terms) USING (doc_id)
  GROUP BY entity, term HAVING count(DISTINCT copy) >= {privacy.SUPPORT}),
total AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents),
shares AS (
  SELECT entity, term, CASE WHEN ln(n / n_entity) > 0
    THEN ln(CAST(least(n_both, n_entity, n_term) AS DOUBLE) * n / (CAST(n_entity AS DOUBLE) * CAST(n_term AS DOUBLE))) / ln(n / n_entity)
    ELSE 0 END AS share
  FROM pairs JOIN docs_with USING (entity) JOIN words USING (term), total),
spots AS (
  SELECT doc_id, a, b, max(share) AS share FROM mentions JOIN terms USING (doc_id) JOIN shares USING (entity, term)
  WHERE share >= {privacy.GENERALISE} GROUP BY doc_id, a, b),
extra AS (
  SELECT doc_id, list({{'a': a, 'o': 4, 'b': b, 'k': CASE WHEN share >= {privacy.REMOVE} THEN 'remove' ELSE 'generalise' END}}) AS added
  FROM spots GROUP BY doc_id)
SELECT doc_id, {", ".join(map(_of_kind, _PRIVATE))}, coalesce(len(added), 0) AS n_terms,
       sha256({_joined("base")}) AS base_sha256,
       {_joined("list_sort(list_concat(base, coalesce(added, [])))")} AS spans
FROM f LEFT JOIN extra USING (doc_id)
"""


NEGATIVES = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         CAST(coalesce(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])), 0) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


LINES = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (
  SELECT r, i, l[i] AS line,
         translate(regexp_replace(l[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, l, unnest(range(1, len(l) + 1)) AS i FROM d)),
f AS (SELECT k FROM x WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10),
o AS (
  SELECT r, count(f.k) AS n_dropped, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.k IS NULL) AS kept
  FROM x LEFT JOIN f USING (k) GROUP BY r)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d JOIN o USING (r)
"""


def _least(*options: str) -> str:
    return f"list_min(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))"


def _edit(state: str, edit: str, cost: str, when: str = "true", line: str | None = None) -> str:
    """The state after an edit, or NULL; a state is its cost, the edits and the repaired lines."""
    lines = f"list_append({state}.r, {line})" if line else f"{state}.r"
    return f"CASE WHEN {state} IS NOT NULL AND {when} THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 'r': {lines}}} END"


def _inserts(frame: str) -> str:
    """The four states with the inserts that may follow, in two steps."""
    user = ", ".join(_edit(f"s{k}", "I", "3", line="'user:'") for k in (0, 1, 3))
    return f"""
  SELECT * REPLACE ({_least("s3", _edit("s2", "I", "3", line="'assistant:'"))} AS s3)
  FROM (SELECT * REPLACE ({_least("s2", user)} AS s2) FROM ({frame}))"""


def _repairs() -> str:
    start, none = "{'c': 0::BIGINT, 'a': '', 'r': CAST([] AS VARCHAR[])}", "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, r VARCHAR[]))"
    stays, extra = "fault < 2", "3 * (fault = 1)::INT"

    def kept(k: int, initial: str) -> str:
        return _edit(f"s{k}", "K", extra, f"{stays} AND initial = '{initial}'", "role || ':' || text")

    def rerole(k: int, role: str) -> str:
        return _edit(f"s{k}", "R", f"3 + {extra}", stays, f"'{role}:' || text")

    after = [
        _least(_edit("s0", "D", "4")),
        _least(_edit("s1", "D", "4"), kept(0, "s")),
        _least(_edit("s2", "D", "4"), *(f(k, x) for k in (0, 1, 3) for f, x in ((kept, "u"), (rerole, "user")))),
        _least(_edit("s3", "D", "4"), kept(2, "a"), rerole(2, "assistant")),
    ]
    following = f"SELECT p.conv, p.i + 1 AS i, {', '.join(f'{x} AS s{k}' for k, x in enumerate(after))} FROM p JOIN f ON f.conv = p.conv AND f.i = p.i + 1"
    first = f"SELECT DISTINCT conv, 0::BIGINT AS i, {start} AS s0, {none} AS s1, {none} AS s2, {none} AS s3 FROM f"
    return rf"""
WITH RECURSIVE t AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS steps),
o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), 'none') AS conv,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
h AS (
  SELECT o.*, xor(list_reduce(list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS damage FROM o, t),
d AS (
  SELECT conv, conv_id, turn, CASE damage WHEN 4 THEN 'user' ELSE role END AS role,
         CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT h.*, unnest(CASE damage WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) FROM h)),
n AS (
  SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
f AS MATERIALIZED (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 3
                 WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 2
                 WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 1 ELSE 0 END AS fault,
         lag(initial) OVER (PARTITION BY conv ORDER BY i) || initial AS pair
  FROM n),
p AS ({_inserts(first)} UNION ALL {_inserts(following)}),
e AS (
  SELECT conv, {_least("s0", "s3")} AS s FROM p
  WHERE (conv, i) IN (SELECT conv, max(i) FROM f GROUP BY conv)),
c AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 3) AS blank,
         count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 1) AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(s.c, 0) AS cost,
       coalesce(s.a, '') AS audit, sha256(coalesce(array_to_string(s.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM o) LEFT JOIN c USING (conv) LEFT JOIN e USING (conv)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontaminate": CONTAINED,
        "op3_jaccard_join": SIMILAR,
        "op4_secret_scan": _secrets(),
        "op5_mix_sources": MIX,
        "op7_exact_dedup": EXACT,
        "op10_personal_data": _private(),
        "op11_hard_negatives": NEGATIVES,
        "op12_conversation_repair": _repairs(),
        "op13_line_dedup": LINES,
    }
