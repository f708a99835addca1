"""SQL twins of the operators' queries, for DuckDB."""

from .mixing import BLOCK_ROWS, CYCLE, SEED
from .resampling import BUCKETS, DRAWN_PERCENT, LEAST_WORDS
from .resampling import SEED as DRAW_SEED
from .reputation import ADDRESS, DOTS, MAX_BAD, PORT, SECOND_LEVEL, USER, Z
from .secrets import ACCESS, ASSIGN, ENDPOINT, HEX, IDENT, SCOPE, VALUE

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORD = r"'[^\x20\x09-\x0D]+'"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


MIX = f"""
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
plan AS (
  SELECT source, n, greatest(cast(floor(sqrt(n) * {CYCLE} / (SELECT sum(sqrt(n)) FROM counts) + 0.5) AS bigint), 1) AS e FROM counts
),
ranked AS (SELECT *, row_number() OVER (ORDER BY e DESC, coalesce(source, ''), source NULLS FIRST) AS k FROM plan),
one AS (SELECT list(e ORDER BY k) AS e, cast(sum(e) AS bigint) AS p, count(*) AS m FROM ranked),
sim AS (
  SELECT cast(-1 AS bigint) AS t, cast(0 AS bigint) AS k, cast(0 AS bigint) AS turn, list_transform((SELECT e FROM one), lambda x: cast(0 AS bigint)) AS done
  UNION ALL
  SELECT t, pick.k, done[pick.k] + 1, list_transform(done, lambda d, i: CASE WHEN i = pick.k THEN d + 1 ELSE d END)
  FROM (
    SELECT s.t + 1 AS t, s.done, list_min(list_transform(
      list_filter(range(1, m + 1), lambda i: s.done[i] < e[i] AND (s.done[i] * p) // e[i] <= s.t + 1),
      lambda i: {{'due': ((s.done[i] + 1) * p + e[i] - 1) // e[i], 'k': i}})) AS pick
    FROM sim s, one WHERE s.t + 1 < p
  )
),
slots AS (SELECT sim.t AS slot, ranked.source, ranked.e, sim.turn FROM sim JOIN ranked USING (k) WHERE sim.t >= 0),
rows_ AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('{SEED}:' || doc_id), doc_id) AS nth FROM documents
),
placed AS (
  SELECT r.doc_id, r.source, r.nth, (r.nth - 1) // {BLOCK_ROWS} + 1 AS block, ((r.nth - 1) // {BLOCK_ROWS}) // plan.e AS cycle,
         ((r.nth - 1) // {BLOCK_ROWS}) % plan.e + 1 AS turn
  FROM rows_ r JOIN plan ON r.source IS NOT DISTINCT FROM plan.source
)
SELECT doc_id, p.source, block, cycle, slot, row_number() OVER (ORDER BY cycle, slot, nth) - 1 AS position
FROM placed p JOIN slots s ON p.source IS NOT DISTINCT FROM s.source AND p.turn = s.turn
"""

NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), {_WORD}) AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w)
),
size AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM both_ JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON e.a = r.c
),
comp AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN comp c USING (doc_id) LEFT JOIN size s USING (doc_id)
"""

LINES = f"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
),
keyed AS (SELECT *, translate(trim(line, {_SPACE}), {_LOWER}) AS k FROM lines),
shared AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT keyed.*, first IS NOT NULL AND first <> doc_id AS gone FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def _matches(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    q = _quoted(pattern)
    return f"""
  SELECT doc_id, {rank} AS k, '{kind}' AS kind, gaps + before AS s, gaps + before + len AS e, run FROM (
    SELECT doc_id, run, part, length(run) AS len, sum(length(gap)) OVER (PARTITION BY doc_id ORDER BY i) AS gaps,
      sum(length(run)) OVER (PARTITION BY doc_id ORDER BY i) - length(run) AS before
    FROM (SELECT doc_id, unnest(f) AS run, unnest(g) AS part, unnest(p[1:len(f)]) AS gap, generate_subscripts(f, 1) AS i FROM (
      SELECT doc_id, regexp_extract_all(t, {q}) AS f, regexp_extract_all(t, {q}, {group}) AS g, string_split_regex(t, {q}) AS p FROM docs WHERE regexp_matches(t, {q})))
  ) WHERE length(part) >= {least}"""


SECRETS = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(_matches(*x) for x in (
    ("assign", 0, ASSIGN, 2, 6), ("access", 1, ACCESS, 0, 0), ("hex", 2, HEX, 0, 0), ("ident", 3, IDENT, 0, 0), ("value", 4, VALUE, 0, 0), ("endpoint", 5, ENDPOINT, 0, 0)))}
),
parts AS (
  SELECT doc_id, k, kind, cast(s AS bigint) AS s, cast(e AS bigint) AS e, CASE WHEN k IN (1, 3) THEN 'id' WHEN k = 5 THEN 'at' ELSE 'secret' END AS role
  FROM found
),
met AS (
  SELECT w.doc_id, w.k, w.kind, w.s, w.e, list(DISTINCT o.role) AS met
  FROM parts w JOIN parts o ON w.doc_id = o.doc_id AND w.k >= 3 AND w.role <> o.role
    AND greatest(w.s, o.s) - least(w.e, o.e) BETWEEN 0 AND {SCOPE}
  GROUP BY ALL
),
every AS (
  SELECT doc_id, k, kind, s, e FROM parts WHERE k < 3
  UNION ALL
  SELECT doc_id, k, kind, s, e FROM met WHERE (k = 4 AND list_contains(met, 'id')) OR (k = 3 AND list_contains(met, 'secret'))
    OR (k = 5 AND list_contains(met, 'id') AND list_contains(met, 'secret'))
),
told AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) FILTER (k < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS spans
  FROM every GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN told USING (doc_id)
"""

WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, cast(n AS bigint) AS payload_bytes, d AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (d)
"""


def _level(name: str, above: str | None) -> str:
    groups = f"""g_{name} AS (
  SELECT {name}{f', {above}' if above else ''}, sum(n) AS n, sum(bad) AS bad FROM counted GROUP BY ALL
),
m_{name} AS (SELECT g.*, {f'p.rate' if above else '(SELECT (bad + 1.0) / (n + 2.0) FROM overall)'}::double AS m FROM g_{name} g {f'JOIN p_{above} p USING ({above})' if above else ''}),
s_{name} AS (
  SELECT least(greatest(1 / greatest(coalesce(CASE WHEN extra > 0 THEN (seen - chance) / extra END, 0.0), 1e-9) - 1, 1.0), 1000.0) AS s FROM (
    SELECT sum(n::double * (bad::double / n - m) * (bad::double / n - m)) AS seen, sum(m * (1 - m)) AS chance, sum((n - 1) * (m * (1 - m))) AS extra FROM m_{name})
),
p_{name} AS (SELECT {name}, a, b, a / (a + b) AS rate FROM (SELECT {name}, m * s + bad AS a, (1 - m) * s + n - bad AS b FROM m_{name}, s_{name}))"""
    return groups


_HIER = f"""
  CASE WHEN len(l) > 2 AND length(l[-1]) = 2 AND l[-2] IN ({', '.join(f"'{x}'" for x in SECOND_LEVEL)}) THEN l[-2] || '.' || l[-1] ELSE l[-1] END"""

REPUTATION = f"""
WITH urls AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {_LOWER}) AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
),
named AS (
  SELECT host, suffix, CASE WHEN regexp_matches(place, '{ADDRESS}') THEN place ELSE array_to_string(l[greatest(len(l) - d + 1, 1):], '.') END AS domain FROM (
    SELECT host, place, l, suffix, len(string_split(suffix, '.')) + 1 AS d FROM (
      SELECT host, place, l, CASE WHEN regexp_matches(place, '{ADDRESS}') THEN place ELSE {_HIER} END AS suffix FROM (
        SELECT host, place, string_split(place, '.') AS l FROM (
          SELECT DISTINCT host, regexp_replace(regexp_replace(regexp_replace(host, '{USER}', ''), '{PORT}', ''), '{DOTS}', '') AS place FROM urls))))
),
counted AS (
  SELECT host, suffix, domain, count(*) AS n, count(*) FILTER (bad) AS bad FROM (
    SELECT u.host, (quality = 0 OR toxic = 1) AS bad FROM urls u JOIN labels ON doc_id = page_id WHERE u.host <> '' AND (quality = 0 OR toxic = 1) IS NOT NULL
  ) JOIN named USING (host) GROUP BY ALL
),
overall AS (SELECT coalesce(sum(n), 0) AS n, coalesce(sum(bad), 0) AS bad FROM counted),
{_level('suffix', None)},
{_level('domain', 'suffix')},
{_level('host', 'domain')},
posts AS (
  SELECT named.host, coalesce(h.a, d.a, s.a, CASE WHEN o.n > 0 THEN o.bad + 1 ELSE 0 END)::double AS a, coalesce(h.b, d.b, s.b, CASE WHEN o.n > 0 THEN o.n - o.bad + 1 ELSE 1 END)::double AS b
  FROM named LEFT JOIN p_host h USING (host) LEFT JOIN p_domain d USING (domain) LEFT JOIN p_suffix s USING (suffix), overall o
),
bounds AS (SELECT host, greatest(a / (a + b) - {Z} * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)), 0.0) AS bad_bound FROM posts),
fits AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM urls
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bad_bound > {MAX_BAD} THEN 'block' ELSE 'allow' END AS verdict,
  round(bad_bound, 6) AS bad_bound
FROM fits LEFT JOIN bounds USING (host)
"""

QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup FROM lines WHERE trim(line, {_SPACE}) <> '' GROUP BY doc_id),
win AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM d WHERE len(w) >= 5),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, cast(len(w) AS bigint) AS n_words, cast(length(array_to_string(w, '')) AS bigint) AS word_chars,
    cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS bigint) AS n_symbols,
    coalesce(l.dup, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(l.n_lines, 0) AS n_lines
  FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR n_symbols > n_words OR word_chars > 20 * n_words OR word_chars < 2 * n_words
    OR 2 * n_dup_lines > n_lines) AS kept
FROM m
"""

#: The 256 values of the byte-wise CRC-32, and the CRC of a text column ``h`` in hex.
_CRC_TABLE = "SELECT list(list_reduce(list_concat([i], range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))) ORDER BY i) AS tab FROM range(256) t(i)"


def _crc(h: str) -> str:
    each = f"list_transform(range(length({h}) // 2), lambda i: cast('0x' || {h}[2 * i + 1:2 * i + 2] AS bigint))"
    return f"xor(list_reduce(list_concat([4294967295], {each}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


RESAMPLING = f"""
WITH crc AS ({_CRC_TABLE}),
texts AS (SELECT 0 AS side, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark),
w AS (SELECT side, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
f AS (SELECT side, doc_id, unnest(w) AS f FROM w),
b AS (SELECT f, {_crc('h')} % {BUCKETS} AS b FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f)), crc),
n AS (SELECT b, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM f JOIN b USING (f) GROUP BY b),
total AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM n),
gain AS (
  SELECT b, floor(1000.0::double * ln((n.t + 1)::double * (total.s + {BUCKETS})::double / ((n.s + 1)::double * (total.t + {BUCKETS})::double)))::bigint AS g FROM n, total
),
weight AS (SELECT doc_id, sum(g) AS weight FROM f JOIN b USING (f) JOIN gain USING (b) WHERE side = 0 GROUP BY doc_id),
scored AS (
  SELECT doc_id, cast(len(w) AS bigint) AS n_features, cast(coalesce(weight, 0) AS bigint) AS weight,
    cast(coalesce(weight, 0) AS bigint) + floor(-1000.0::double * ln(-ln((cast('0x' || sha256('{DRAW_SEED}:' || doc_id)[1:8] AS bigint)::double + 0.5::double) / 4294967296.0::double)))::bigint AS score
  FROM w LEFT JOIN weight USING (doc_id) WHERE side = 0
),
may AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {DRAWN_PERCENT} * n // 100 THEN place END AS rank FROM scored LEFT JOIN may USING (doc_id)
"""


def _levels(name: str, levels: int) -> str:
    """CTEs of a forest's levels above ``{name}0`` (grp, slot, node, n) and of the runs on each."""
    out = []
    for k in range(1, levels + 1):
        out.append(f"{name}r{k} AS MATERIALIZED (SELECT grp, slot // 3 AS run, list(node ORDER BY slot) AS nodes, any_value(n) AS n FROM {name}{k - 1} GROUP BY grp, slot // 3)")
        out.append(f"{name}{k} AS MATERIALIZED (SELECT grp, run AS slot, CASE WHEN n > 1 THEN sha256(array_to_string(nodes, '')) ELSE nodes[1] END AS node, (n + 2) // 3 AS n FROM {name}r{k})")
    return ",\n".join(out)


def _paths(name: str, runs: str, levels: int, start: str) -> str:
    """CTEs that fold ``start`` (grp, slot, proof, fold, ...) along the runs."""
    out = [f"{name}0 AS ({start})"]
    for k in range(1, levels + 1):
        left, right = "array_to_string(nodes[1:slot % 3], '')", "array_to_string(nodes[slot % 3 + 2:], '')"
        out.append(f"""{name}{k} AS (
  SELECT p.* REPLACE (slot // 3 AS slot, CASE WHEN r.n > 1 THEN proof || {left} || {right} ELSE proof END AS proof,
    CASE WHEN r.n > 1 THEN sha256({left} || fold || {right}) ELSE fold END AS fold)
  FROM {name}{k - 1} p JOIN {runs}r{k} r ON r.grp = p.grp AND r.run = p.slot // 3)""")
    return ",\n".join(out)


def _leaf(text: str) -> str:
    parts = [f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


_DEEP, _TOP = 11, 6
MANIFEST = f"""
WITH crc AS ({_CRC_TABLE}),
leaves AS MATERIALIZED (
  SELECT doc_id, coalesce('s' || source, '') AS grp, source, {_leaf('text')} AS leaf,
    CASE WHEN {_crc('h')} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf('text')} END AS fold
  FROM (SELECT *, hex(encode(doc_id::varchar)) AS h FROM documents), crc
),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS slot, count(*) OVER (PARTITION BY grp) AS n FROM leaves
),
a0 AS MATERIALIZED (SELECT grp, slot, leaf AS node, n FROM placed),
{_levels('a', _DEEP)},
sub AS MATERIALIZED (SELECT grp, node, row_number() OVER (ORDER BY grp) - 1 AS nth, count(*) OVER () AS n FROM a{_DEEP}),
b0 AS MATERIALIZED (SELECT 0 AS grp, nth AS slot, node, n FROM sub),
{_levels('b', _TOP)},
{_paths('p', 'a', _DEEP, "SELECT doc_id, grp, leaf, slot, '' AS proof, fold FROM placed")},
{_paths('q', 'b', _TOP, f"SELECT doc_id, 0 AS grp, leaf, sub.node AS subroot, nth AS slot, proof, fold FROM p{_DEEP} JOIN sub USING (grp)")}
SELECT doc_id, leaf, subroot, b{_TOP}.node AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = b{_TOP}.node AS verified FROM q{_TOP}, b{_TOP}
"""

SQL: dict[str, str] = {
    "op1_source_mix": MIX, "op3_near_duplicates": NEAR, "op6_line_dedup": LINES, "op7_secrets": SECRETS, "op8_warc": WARC,
    "op9_url_reputation": REPUTATION, "op10_quality": QUALITY, "op12_merkle_manifest": MANIFEST, "op13_importance_resampling": RESAMPLING,
}
