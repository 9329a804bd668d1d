"""DuckDB text for the queries of this folder that SQL can say."""

from __future__ import annotations

from palimpsest.llm.likelihood_rules import BUCKETS, THRESHOLD, UNIT

#: Fixed values: white space, and DuckDB's spelling of the token pattern.
_WHITE = r"\x20\x09-\x0D"
_TOKEN = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+|[!-/:-@\[-`{-~]+"

THRESHOLD_SEARCH = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON len(a.q) = len(b.q) AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

LIKELIHOOD_RULES = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
step AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
tok AS (SELECT rid, doc_id, regexp_extract_all(text, '{_TOKEN}') AS t FROM d),
each AS (SELECT rid, doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM tok),
bytes AS (SELECT w, list_transform(range(octet_length(encode(w))), lambda k: ('0x' || substr(hex(encode(w)), 2 * k + 1, 2))::BIGINT) AS b FROM (SELECT DISTINCT w FROM each)),
crc AS (SELECT w, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, step),
hashed AS (SELECT rid, doc_id, i, h, lead(h) OVER (PARTITION BY rid ORDER BY i) AS h2 FROM each JOIN crc USING (w)),
grams AS (SELECT rid, doc_id, (h * 31 + h2) % {BUCKETS} AS bucket FROM hashed WHERE h2 IS NOT NULL),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
counts AS (SELECT bucket, count(*) AS raw, count(g.doc_id) AS target FROM grams LEFT JOIN good g ON g.doc_id = grams.doc_id GROUP BY bucket),
totals AS (SELECT sum(raw) AS r, sum(target) AS t FROM counts),
model AS (SELECT bucket, CASE WHEN t > 0 THEN floor((ln((target + 1.0::DOUBLE) / (t + {BUCKETS})) - ln((raw + 1.0::DOUBLE) / (r + {BUCKETS}))) * {UNIT} + 0.5) ELSE 0 END AS weight FROM counts, totals),
score AS (SELECT rid, count(*) AS n, sum(weight) AS total FROM grams JOIN model USING (bucket) GROUP BY rid),
ws AS (SELECT rid, regexp_extract_all(text, '[^{_WHITE}]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{_WHITE}]')) AS lines, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols FROM d),
windows AS (SELECT rid, i, array_to_string(ws[i : i + 4], ' ') AS win FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM ws WHERE len(ws) >= 5)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM windows) WHERE c > 1),
repeats AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, range(5) t(k) GROUP BY rid),
base AS (
  SELECT d.rid, d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN ws ON ws.rid = d.rid LEFT JOIN repeats ON repeats.rid = d.rid
), ruled AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(total, 0) >= {THRESHOLD} * coalesce(n, 0) AS kept
FROM ruled LEFT JOIN score ON score.rid = ruled.rid
"""

PART_ENUM = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{_WHITE}]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT rid, array_to_string(ws[i : i + 3], ' ') AS s FROM (SELECT rid, ws, unnest(range(1, len(ws) - 2)) AS i FROM d WHERE len(ws) >= 4)
  UNION ALL SELECT rid, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND 3
),
size AS (SELECT rid, count(*) AS n FROM sh GROUP BY rid),
pairs AS (SELECT a.rid AS a, b.rid AS b, count(*) AS shared FROM sh a JOIN sh b ON a.s = b.s AND a.rid <> b.rid GROUP BY a.rid, b.rid),
links AS (SELECT a, b FROM pairs JOIN size x ON x.rid = a JOIN size y ON y.rid = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
reach AS (SELECT rid AS a, rid AS b FROM size UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a AS rid, min(doc_id) AS component_id FROM reach JOIN d ON d.rid = reach.b GROUP BY a)
SELECT d.doc_id, coalesce(size.n, 0)::BIGINT AS n_shingles, CASE WHEN size.n IS NULL THEN d.doc_id ELSE component_id END AS component_id
FROM d LEFT JOIN size ON size.rid = d.rid LEFT JOIN least ON least.rid = d.rid
"""

COVER_DEDUP = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS hx, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
starts AS (SELECT rid, s, md5(substr(hx, 2 * s + 1, 400)) AS k FROM (SELECT rid, hx, unnest(range(n - 199)) AS s FROM d WHERE n >= 200)),
many AS (SELECT k FROM starts GROUP BY k HAVING count(*) > 1),
again AS (SELECT rid, s FROM starts WHERE k IN (SELECT k FROM many)),
turn AS (SELECT rid, s, CASE WHEN s - lag(s) OVER (PARTITION BY rid ORDER BY s) <= 200 THEN 0 ELSE 1 END AS new FROM again),
run AS (SELECT rid, s, sum(new) OVER (PARTITION BY rid ORDER BY s) AS run FROM turn),
span AS (SELECT rid, min(s) AS lo, max(s) + 200 AS hi FROM run GROUP BY rid, run),
gap AS (
  SELECT rid, lag(hi, 1, 0) OVER (PARTITION BY rid ORDER BY lo) AS lo, lo AS hi FROM span
  UNION ALL SELECT d.rid, coalesce(max(span.hi), 0), d.n FROM d LEFT JOIN span ON span.rid = d.rid GROUP BY d.rid, d.n
),
kept AS (SELECT gap.rid, string_agg(substr(hx, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY lo) AS hx FROM gap JOIN d ON d.rid = gap.rid GROUP BY gap.rid),
total AS (SELECT rid, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM span GROUP BY rid)
SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(kept.hx)) AS kept_sha256
FROM d JOIN kept ON kept.rid = d.rid LEFT JOIN total ON total.rid = d.rid
"""


def tree_mixing(max_epochs: int = 2, seed: int = 7) -> str:
    """The mixture over domain, language and source with equal weights and as many tokens as there are."""
    part = lambda c: f"CASE WHEN {c} IS NULL THEN 'n' ELSE 'v' || {c} END"  # noqa: E731
    names = [part(c) for c in ("domain", "lang", "source")]
    path = lambda k: " || chr(31) || ".join(names[:k]) if k else "''"  # noqa: E731
    levels = "".join(
        f"""
k{k} AS (SELECT {path(k - 1)} AS parent, {path(k)} AS node, sum(tokens) * {max_epochs} AS capacity FROM leaves GROUP BY ALL),
o{k} AS (SELECT k.*, b.budget - coalesce(sum(capacity) OVER (PARTITION BY parent ORDER BY capacity, k.node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  row_number() OVER (PARTITION BY parent ORDER BY capacity, k.node) AS place, count(*) OVER (PARTITION BY parent) - row_number() OVER (PARTITION BY parent ORDER BY capacity, k.node) + 1 AS others
  FROM k{k} k JOIN b{k - 1} b ON b.node = k.parent),
f{k} AS (SELECT *, min(CASE WHEN capacity * others > rest THEN place END) OVER (PARTITION BY parent) AS opens FROM o{k}),
p{k} AS (SELECT *, place >= opens AND opens IS NOT NULL AS is_open, max(CASE WHEN place = opens THEN rest END) OVER (PARTITION BY parent) AS pool, max(CASE WHEN place = opens THEN others END) OVER (PARTITION BY parent) AS heads FROM f{k}),
b{k} AS (SELECT node, CASE WHEN is_open THEN pool // heads + CASE WHEN row_number() OVER (PARTITION BY parent ORDER BY is_open DESC, node) <= pool % heads THEN 1 ELSE 0 END ELSE capacity END AS budget FROM p{k}),"""
        for k in (1, 2, 3)
    )
    crc = f"""step AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
named AS (SELECT source, list_transform(range(octet_length(encode(source))), lambda k: ('0x' || substr(hex(encode(source)), 2 * k + 1, 2))::BIGINT) AS b FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)),
domains AS (SELECT source, 'domain' || (xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 4) AS domain FROM named, step),"""
    return rf"""
WITH {crc}
d AS (SELECT doc_id, domain, lang, documents.source AS source, len(regexp_extract_all(coalesce(text, ''), '[^{_WHITE}]+'))::BIGINT AS n_tokens FROM documents LEFT JOIN domains ON domains.source = documents.source),
leaves AS (SELECT domain, lang, source, {path(3)} AS leaf, sum(n_tokens) AS tokens FROM d GROUP BY ALL),
b0 AS (SELECT '' AS node, sum(tokens) AS budget FROM leaves),{levels}
plan AS (SELECT leaf, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS whole, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM leaves JOIN b3 ON b3.node = leaves.leaf),
t AS (SELECT d.*, {path(3)} AS leaf FROM d),
turns AS (SELECT t.*, plan.whole, plan.rest, unnest(range(0, (whole + 1)::BIGINT)) AS epoch FROM t JOIN plan ON plan.leaf = t.leaf),
upto AS (SELECT *, sum(n_tokens) OVER (PARTITION BY leaf, epoch ORDER BY md5('{seed}:' || epoch || ':' || doc_id) ROWS UNBOUNDED PRECEDING) AS upto FROM turns)
SELECT doc_id, domain, lang, source, n_tokens, epoch::BIGINT AS epoch FROM upto WHERE epoch < whole OR (rest > 0 AND upto <= rest)
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BRACKET_RESAMPLING = rf"""
WITH step AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
texts AS (
  SELECT row_number() OVER () AS rid, doc_id, text, 0 AS target FROM documents
  UNION ALL SELECT NULL, NULL, text, 1 FROM benchmark
),
each AS (SELECT rid, target, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')) AS w FROM texts),
bytes AS (SELECT w, list_transform(range(octet_length(encode(w))), lambda k: ('0x' || substr(hex(encode(w)), 2 * k + 1, 2))::BIGINT) AS b FROM (SELECT DISTINCT w FROM each)),
crc AS (SELECT w, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, step),
hashed AS (SELECT rid, target, bucket FROM each JOIN crc USING (w)),
counts AS (SELECT bucket, count(*) FILTER (target = 0) AS s, count(*) FILTER (target = 1) AS t FROM hashed GROUP BY bucket),
totals AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM counts),
gains AS (SELECT bucket, floor(1000 * ln(((t + 1) * (all_s + 10000))::DOUBLE / ((s + 1) * (all_t + 10000))::DOUBLE))::BIGINT AS gain FROM counts, totals),
weights AS (SELECT rid, count(*) AS n, sum(gain)::BIGINT AS weight FROM hashed JOIN gains USING (bucket) WHERE target = 0 GROUP BY rid),
scores AS (
  SELECT texts.rid, doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM texts LEFT JOIN weights ON weights.rid = texts.rid WHERE target = 0
),
ranks AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id, n_features, weight) AS place, count(*) OVER () AS able FROM scores WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * able // 100 THEN place END::BIGINT AS rank
FROM scores LEFT JOIN ranks ON ranks.rid = scores.rid
"""

BOUND_COLLOCATIONS = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?
-]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
grams AS (SELECT lang, size, ws[i : i + size - 1] AS ws FROM (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM w, range(1, 5) sizes(size))),
f AS (SELECT lang, size, ws, count(*)::HUGEINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
cut AS (SELECT lang, size, ws, f AS a, unnest(range(1, size)) AS k FROM f WHERE size > 1),
cuts AS (
  SELECT cut.lang, cut.size, cut.ws, a, k, x.f AS l, y.f AS r, 2000000 * a // (x.f + y.f) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.ws = cut.ws[1 : k] JOIN f y ON y.lang = cut.lang AND y.ws = cut.ws[k + 1 : cut.size]
),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
inner_of AS (SELECT lang, size, f, ws, part, unnest(range(1, size - part + 2)) AS i FROM f, range(2, 4) parts(part) WHERE part < size),
around AS (SELECT lang, ws[i : i + part - 1] AS ws, max(f) AS most FROM inner_of GROUP BY ALL),
stays AS (SELECT lowest.*, array_to_string(lowest.ws, ' ') AS phrase FROM lowest LEFT JOIN around ON around.lang = lowest.lang AND around.ws = lowest.ws WHERE most IS NULL OR 100 * most < 80 * a)
SELECT stays.lang, row_number() OVER (PARTITION BY stays.lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM stays JOIN totals ON totals.lang = stays.lang QUALIFY rank <= 2000
"""


ORACLE = {"op4_threshold_search": THRESHOLD_SEARCH, "op5_part_enum": PART_ENUM, "op7_cover_dedup": COVER_DEDUP, "op8_likelihood_rules": LIKELIHOOD_RULES, "op10_tree_mixing": tree_mixing(),
          "op11_bracket_resampling": BRACKET_RESAMPLING, "op13_bound_collocations": BOUND_COLLOCATIONS}
