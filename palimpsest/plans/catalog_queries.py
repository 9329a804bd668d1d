"""Registered queries: links, listings, ranges and fetch logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import catalog as ct
from palimpsest.operators import intervals
from palimpsest.plans import bindings as b
from palimpsest.plans.registry import query, table

_LINKS = """SELECT o_orderkey, concat(CASE WHEN o_orderkey % 3 = 0 THEN 'https://' ELSE '' END,
  ['huggingface.co', 'WWW.huggingface.co', 'github.com', 'raw.githubusercontent.com', 'media.githubusercontent.com', 'example.com', 'hf.co'][1 + o_orderkey % 7], '/',
  ['acme', 'media', 'datasets', 'spaces'][1 + o_custkey % 4], '/', lower(o_orderpriority[3:]), CASE WHEN o_custkey % 5 = 0 THEN '.git' ELSE '' END,
  ['', '/tree/main', '/blob/v2/a/b.safetensors', '/releases/tag/v1', '/releases/download/v1/x/y.bin', '/releases/latest', '/resolve/abc/q.gguf', '/raw/dev/z', '/'][1 + o_custkey % 9],
  CASE WHEN o_orderkey % 4 = 0 THEN '?x=1' ELSE '' END) AS link FROM orders"""


def links(spark, sf):
    o = table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")

    def pick(items, index):
        return F.element_at(F.array(*[F.lit(i) for i in items]), (index + 1).cast("int"))

    return o.select("o_orderkey", F.concat(
        F.when(k % 3 == 0, "https://").otherwise(""),
        pick(["huggingface.co", "WWW.huggingface.co", "github.com", "raw.githubusercontent.com", "media.githubusercontent.com", "example.com", "hf.co"], k % 7), F.lit("/"),
        pick(["acme", "media", "datasets", "spaces"], c % 4), F.lit("/"), F.lower(F.substring("o_orderpriority", 3, 100)), F.when(c % 5 == 0, ".git").otherwise(""),
        pick(["", "/tree/main", "/blob/v2/a/b.safetensors", "/releases/tag/v1", "/releases/download/v1/x/y.bin", "/releases/latest", "/resolve/abc/q.gguf", "/raw/dev/z", "/"], c % 9),
        F.when(k % 4 == 0, "?x=1").otherwise("")).alias("link"))


_PARSE = """WITH l AS (SELECT *, lower(regexp_extract(u, '^[^:/?#]+://([^/:?#]+)', 1)) AS h, list_filter(string_split(regexp_extract(u, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS p FROM (
    SELECT *, CASE WHEN contains(link, '://') THEN link ELSE 'https://' || link END AS u FROM (%s))),
  k AS (SELECT *, len(p) AS n, h IN ('huggingface.co', 'www.huggingface.co', 'hf.co') AS hub, h IN ('github.com', 'www.github.com') AS git, h = 'raw.githubusercontent.com' AS raw,
    h = 'media.githubusercontent.com' AS med FROM l),
  v AS (SELECT *, coalesce((hub AND n >= 2 AND p[1] NOT IN ('datasets', 'spaces', 'api', 'docs')) OR (git AND n >= 2) OR (raw AND n >= 4) OR (med AND n >= 5 AND p[1] = 'media'), false) AS ok,
    git AND n >= 4 AND p[3] = 'releases' AS rel, (hub AND n >= 4 AND p[3] IN ('tree', 'blob', 'resolve')) OR (git AND n >= 4 AND p[3] IN ('tree', 'blob', 'raw')) AS rev FROM k)
  SELECT %s, CASE WHEN ok THEN CASE WHEN hub THEN 'huggingface' ELSE 'github' END END AS host,
    CASE WHEN ok THEN CASE WHEN hub OR raw THEN p[1] || '/' || p[2] WHEN git THEN p[1] || '/' || regexp_replace(p[2], '\\.git$', '') ELSE p[2] || '/' || p[3] END END AS repo,
    CASE WHEN ok THEN CASE WHEN rev THEN p[4] WHEN raw THEN p[3] WHEN med THEN p[4] END END AS revision,
    CASE WHEN ok THEN CASE WHEN rev AND n > 4 THEN array_to_string(p[5:], '/') WHEN raw THEN array_to_string(p[4:], '/') WHEN med THEN array_to_string(p[5:], '/') END END AS path,
    CASE WHEN ok AND rel THEN CASE WHEN p[4] = 'tag' AND n >= 5 THEN p[5] WHEN p[4] = 'download' AND n >= 6 THEN p[5] WHEN p[4] = 'latest' THEN 'latest' END END AS release_tag,
    CASE WHEN ok AND rel AND p[4] = 'download' AND n >= 6 THEN array_to_string(p[6:], '/') END AS release_asset,
    CASE WHEN NOT ok THEN 'unsupported link' END AS error FROM v"""
_COLS = ["host", "repo", "revision", "path", "release_tag", "release_asset", "error"]


@query("b1_model_links", _PARSE % (_LINKS, "o_orderkey"))
def _(spark, sf):
    return ct.parse_links(links(spark, sf)).select("o_orderkey", *_COLS)


@query("b1_page_links", _PARSE % ("SELECT page_id, url AS link FROM pages", "page_id"))
def _(spark, sf):
    return ct.parse_links(table(spark, sf, "pages").select("page_id", F.col("url").alias("link"))).select("page_id", *_COLS)


# one repo per supplier; files from its line items
_FILES = """SELECT DISTINCT l_suppkey AS repo, concat(['', 'unet/', 'a/b/'][1 + l_linenumber % 3], ['model', 'LoRA_v', 'readme', 'config', 'index'][1 + l_partkey % 5], l_orderkey % 4,
  ['', '.fp16', '-ema', '_bf16'][1 + l_orderkey % 4], ['.safetensors', '.gguf', '.CKPT', '.onnx', '.json', '.md'][1 + (l_orderkey + l_linenumber) % 6]) AS path,
  CASE WHEN l_orderkey % 4 = 3 THEN NULL ELSE ((l_suppkey * 31 + l_orderkey % 4 * 7 + (l_orderkey + l_linenumber) % 6) * 13) END::BIGINT AS size FROM lineitem"""


def files(spark, sf):
    li = table(spark, sf, "lineitem")
    k, n, p, s = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")

    def pick(items, index):
        return F.element_at(F.array(*[F.lit(i) for i in items]), (index + 1).cast("int"))

    return li.select(
        s.alias("repo"), F.concat(pick(["", "unet/", "a/b/"], n % 3), pick(["model", "LoRA_v", "readme", "config", "index"], p % 5), (k % 4).cast("string"),
                                  pick(["", ".fp16", "-ema", "_bf16"], k % 4), pick([".safetensors", ".gguf", ".CKPT", ".onnx", ".json", ".md"], (k + n) % 6)).alias("path"),
        F.when(k % 4 != 3, (s * 31 + k % 4 * 7 + (k + n) % 6) * 13).cast("bigint").alias("size")).distinct()


_FORMAT = """CASE WHEN lower(path) LIKE '%.safetensors' THEN 'safetensors' WHEN lower(path) LIKE '%.gguf' THEN 'gguf' WHEN regexp_matches(lower(path), '\\.(ckpt|pt|pth|bin)$') THEN 'pickle'
  WHEN lower(path) LIKE '%.onnx' THEN 'onnx' ELSE 'other' END"""


@query("b2_weight_format", f"SELECT repo, {_FORMAT} AS format, count(*) AS n, bool_and({_FORMAT} <> 'other') AS is_weights FROM ({_FILES}) GROUP BY repo, format")
def _(spark, sf):
    f = files(spark, sf)
    return f.groupBy("repo", ct.weight_format(F.col("path")).alias("format")).agg(F.count(F.lit(1)).alias("n"), F.every(ct.is_weights(F.col("path"))).alias("is_weights"))


_SCOPES = """SELECT s_suppkey AS repo, ['unet', 'unet/model0.safetensors', '', 'a/', 'missing', 'unet/config0.json'][1 + s_suppkey % 6] AS scope FROM supplier"""
_DIR = "CASE WHEN contains({0}, '/') THEN regexp_replace({0}, '/[^/]*$', '') ELSE '' END"


@query("b3_path_scope", f"""WITH j AS (SELECT f.repo, path, scope, bool_or(path = scope) OVER (PARTITION BY f.repo) AS exact FROM ({_FILES}) f JOIN ({_SCOPES}) s ON s.repo = f.repo)
  SELECT repo, scope, path FROM j WHERE CASE WHEN scope = '' THEN true WHEN exact THEN path = scope OR ({_DIR.format('path')} = {_DIR.format('scope')} AND
    (lower(path) LIKE '%/readme.md' OR lower(path) = 'readme.md' OR lower(path) LIKE '%.json')) ELSE starts_with(path, CASE WHEN scope LIKE '%/' THEN scope ELSE scope || '/' END) END""")
def _(spark, sf):
    s = table(spark, sf, "supplier")
    names = ["unet", "unet/model0.safetensors", "", "a/", "missing", "unet/config0.json"]
    scopes = s.select(F.col("s_suppkey").alias("repo"), F.element_at(F.array(*[F.lit(n) for n in names]), (1 + F.col("s_suppkey") % 6).cast("int")).alias("scope"))
    return ct.scope_files(files(spark, sf).select("repo", "path"), scopes).select("repo", "scope", "path")


_POINTER = """concat(CASE WHEN repo % 7 = 0 THEN 'hello' ELSE 'version https://git-lfs.github.com/spec/v1' END, chr(10), 'oid sha256:', sha256(path), chr(10), 'size ', repo * 1000000, chr(10))"""


@query("b4_large_file_pointers", f"""SELECT repo, path, CASE WHEN hit THEN repo * 1000000 ELSE size END AS size, CASE WHEN hit THEN sha256(path) END AS oid FROM (
  SELECT *, coalesce(({_FORMAT}) <> 'other' AND size < 1024 AND repo % 7 <> 0, false) AS hit FROM ({_FILES}))""")
def _(spark, sf):
    f = files(spark, sf)
    head = F.when(F.col("repo") % 7 == 0, "hello").otherwise("version https://git-lfs.github.com/spec/v1")
    text = F.concat(head, F.lit("\noid sha256:"), F.sha2(F.col("path").cast("binary"), 256), F.lit("\nsize "), (F.col("repo") * 1000000).cast("string"), F.lit("\n"))
    texts = f.select("repo", "path", text.alias("content"))
    return ct.resolve_pointers(f, texts).select("repo", "path", "size", "oid")


@query("b5_repo_totals", f"""SELECT repo, coalesce(sum(size), 0)::BIGINT AS repo_bytes, coalesce(sum(size) FILTER (({_FORMAT}) <> 'other'), 0)::BIGINT AS weight_bytes FROM ({_FILES}) GROUP BY repo""")
def _(spark, sf):
    return ct.totals(files(spark, sf), ["repo"])


@query("b5_file_lookup", f"SELECT repo, path FROM ({_FILES}) WHERE path = 'config0.json' OR path LIKE '%/config0.json'")
def _(spark, sf):
    return ct.file_named(files(spark, sf), "config0.json").select("repo", "path")


_SHARDS = f"""SELECT repo, concat('unet/set', length(path) % 2, '.safetensors.index.json') AS index_path, path FROM ({_FILES}) WHERE path LIKE 'unet/model%.safetensors' OR path LIKE 'unet/LoRA%.safetensors'"""
_HEADERS = f"SELECT repo, path FROM ({_FILES}) WHERE path LIKE '%.safetensors' AND (repo + length(path)) % 3 <> 0"


def shards_and_headers(spark, sf):
    f = files(spark, sf)
    st = f.where(F.col("path").endswith(".safetensors"))
    shards = st.where(F.col("path").startswith("unet/model") | F.col("path").startswith("unet/LoRA")).select(
        "repo", F.concat(F.lit("unet/set"), (F.length("path") % 2).cast("string"), F.lit(".safetensors.index.json")).alias("index_path"), "path")
    return f, shards, st.where((F.col("repo") + F.length("path")) % 3 != 0).select("repo", "path")


@query("b6_unit_grouping", f"""WITH f AS ({_FILES}), s AS ({_SHARDS}), h AS ({_HEADERS})
  SELECT repo, replace(index_path, '.index.json', '') AS unit, path FROM s WHERE (repo, index_path) IN (SELECT (s.repo, s.index_path) FROM s JOIN h USING (repo, path))
  UNION ALL SELECT repo, path, path FROM h WHERE (repo, path) NOT IN (SELECT (repo, path) FROM s)""")
def _(spark, sf):
    return ct.group_units(*shards_and_headers(spark, sf))


_STEM = "replace(lower(path), '.safetensors', '')"
for _t in ct.VARIANT_TOKENS:
    _STEM = f"replace({_STEM}, '{_t}', '')"


@query("b7_variant_dedupe", f"""SELECT repo, stem, path, size FROM (SELECT *, row_number() OVER (PARTITION BY repo, stem ORDER BY size NULLS LAST, path) AS k FROM (
  SELECT repo, path, size, {_STEM} AS stem FROM ({_FILES}) WHERE path LIKE '%.safetensors')) WHERE k = 1""")
def _(spark, sf):
    st = files(spark, sf).where(F.col("path").endswith(".safetensors")).withColumn("ord", F.col("path"))
    return ct.dedupe_variants(st, ["repo"], "ord")


@query("b8_unit_assembly", f"""WITH f AS ({_FILES}), u AS (SELECT repo AS unit, concat(repo, '/', path) AS path, row_number() OVER (PARTITION BY repo ORDER BY path) AS ord, size FROM f WHERE path LIKE '%.safetensors'),
  t AS (SELECT *, 't' || (ord % 5) AS name, ord * 10 AS bytes FROM u), w AS (SELECT unit, name, arg_max(bytes, ord) AS bytes FROM t GROUP BY unit, name),
  m AS (SELECT unit, 'k' || (ord % 3) AS key, arg_min('v' || ord, ord) AS value FROM u GROUP BY unit, key)
  SELECT unit, (SELECT count(*) FROM w WHERE w.unit = u.unit) AS tensors, (SELECT sum(bytes)::BIGINT FROM w WHERE w.unit = u.unit) AS tensor_bytes,
    coalesce(sum(size), 0)::BIGINT AS byte_size, (SELECT string_agg(key || '=' || value, ',' ORDER BY key) FROM m WHERE m.unit = u.unit) AS metadata FROM u GROUP BY unit""")
def _(spark, sf):
    from pyspark.sql import Window

    st = files(spark, sf).where(F.col("path").endswith(".safetensors"))
    u = st.select(F.col("repo").alias("unit"), F.concat(F.col("repo").cast("string"), F.lit("/"), "path").alias("path"),
                  F.row_number().over(Window.partitionBy("repo").orderBy("path")).alias("ord"), "size")
    tensors = u.select("path", F.concat(F.lit("t"), (F.col("ord") % 5).cast("string")).alias("name"), (F.col("ord") * 10).cast("bigint").alias("bytes"))
    meta = u.select("path", F.concat(F.lit("k"), (F.col("ord") % 3).cast("string")).alias("key"), F.concat(F.lit("v"), F.col("ord").cast("string")).alias("value"))
    merged, units = ct.assemble_units(u, tensors, meta)
    sums = merged.groupBy("unit").agg(F.count(F.lit(1)).alias("tensors"), F.sum("bytes").alias("tensor_bytes"))
    text = F.array_join(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return units.join(sums, "unit").select("unit", "tensors", "tensor_bytes", "byte_size", text.alias("metadata"))


_NOTED = f"SELECT *, CASE WHEN (repo + length(path)) % 5 = 0 THEN 'truncated' END AS header_error FROM ({_FILES})"
_NOTE = f"""CASE ({_FORMAT}) WHEN 'safetensors' THEN CASE WHEN header_error IS NOT NULL THEN '{ct.HEADER_BAD} ' || header_error END
  WHEN 'gguf' THEN CASE WHEN header_error IS NOT NULL THEN '{ct.HEADER_BAD} ' || header_error ELSE '{ct.LISTED_ONLY}' END WHEN 'pickle' THEN '{ct.NEVER_LOADED}' WHEN 'onnx' THEN '{ct.NOT_READ}' END"""


def noted(spark, sf):
    f = files(spark, sf).withColumn("header_error", F.when((F.col("repo") + F.length("path")) % 5 == 0, "truncated"))
    return ct.inventory_notes(f)


@query("b9_inventory_notes", f"SELECT repo, path, ({_FORMAT}) AS format, {_NOTE} AS note FROM ({_NOTED}) WHERE ({_FORMAT}) <> 'other'")
def _(spark, sf):
    return noted(spark, sf).select("repo", "path", "format", "note")


@query("b9_inventory_flags", f"SELECT repo, CASE WHEN bool_or(({_FORMAT}) = 'pickle') THEN 'pickle' ELSE '' END AS flags FROM ({_FILES}) WHERE ({_FORMAT}) <> 'other' GROUP BY repo")
def _(spark, sf):
    return ct.inventory_flags(noted(spark, sf), ["repo"]).select("repo", F.array_join("flags", ",").alias("flags"))


_RESP = """SELECT request_id, CASE WHEN request_id % 29 = 0 THEN 403 ELSE status END AS status, CASE WHEN scan_id % 4 <> 0 THEN request_id * 100 END AS lo,
  CASE WHEN scan_id % 4 <> 0 THEN request_id * 100 + bytes + CASE WHEN scan_id = 1 THEN 90000000 ELSE 0 END END AS hi, request_id * 100 + CASE WHEN scan_id = 3 THEN 1 ELSE 0 END AS s,
  bytes + CASE WHEN scan_id = 5 THEN 2 ELSE 0 END + CASE WHEN scan_id = 1 THEN 90000000 ELSE 0 END AS body FROM log"""


@query("b10_fetch_validation", b.with_sql(["log"], f"""SELECT request_id, CASE WHEN lo IS NOT NULL AND status = 200 AND hi > 67108864 THEN 'range-ignored'
  WHEN lo IS NULL AND body > 60000 THEN 'over-limit' WHEN lo IS NOT NULL AND status = 206 AND (request_id % 17 = 0 OR s <> lo) THEN 'wrong-range'
  WHEN status IN (401, 403) THEN 'denied ' || status WHEN status NOT BETWEEN 200 AND 299 THEN 'status ' || status
  WHEN lo IS NOT NULL AND body <> hi - lo THEN 'wrong-length ' || body || ' ' || (hi - lo) ELSE 'ok' END AS outcome FROM ({_RESP})"""))
def _(spark, sf):
    log = b.fetch_log(spark, sf)
    ranged = F.col("scan_id") % 4 != 0
    extra = F.when(F.col("scan_id") == 1, 90000000).otherwise(0)
    lo = F.col("request_id") * 100
    rows = log.select(
        "request_id", F.when(F.col("request_id") % 29 == 0, 403).otherwise(F.col("status")).alias("status"), F.when(ranged, lo).alias("range_lo"),
        F.when(ranged, lo + F.col("bytes") + extra).alias("range_hi"),
        F.when(F.col("request_id") % 17 != 0, F.concat(F.lit("bytes "), (lo + F.when(F.col("scan_id") == 3, 1).otherwise(0)).cast("string"), F.lit("-"),
                                                       (lo + F.col("bytes")).cast("string"), F.lit("/*"))).alias("content_range"),
        (F.col("bytes") + F.when(F.col("scan_id") == 5, 2).otherwise(0) + extra).alias("body_bytes"), F.lit(60000).alias("size_limit"))
    return ct.check_responses(rows, 64 << 20).select("request_id", "outcome")


# of equal ranges the one that opens a block comes first, or the others would fall to the block before it
_COALESCE = """blocks AS MATERIALIZED (SELECT file, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(brk) OVER (PARTITION BY file ORDER BY lo, hi, brk DESC ROWS UNBOUNDED PRECEDING) AS g FROM (
  SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY file ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 4096 THEN 1 ELSE 0 END AS brk FROM rng WHERE hi > lo)) GROUP BY file, g)"""


@query("b11_coalesce_ranges", f"WITH rng AS MATERIALIZED ({b.SQL['rng']}), {_COALESCE} SELECT file, lo, hi FROM blocks")
def _(spark, sf):
    return intervals.coalesce_ranges(b.byte_ranges(spark, sf), gap=4096, bucket=1 << 20)


@query("b12_range_containment", f"""WITH rng AS MATERIALIZED ({b.SQL['rng']}), {_COALESCE} SELECT r.file, r.lo, r.hi, k.lo AS block_lo, k.hi AS block_hi, r.lo - k.lo AS "offset"
  FROM rng r JOIN blocks k ON k.file = r.file AND k.lo <= r.lo AND k.hi >= r.hi WHERE r.hi > r.lo""")
def _(spark, sf):
    ranges = b.byte_ranges(spark, sf)
    return intervals.contain_ranges(ranges, intervals.coalesce_ranges(ranges, gap=4096, bucket=1 << 20), bucket=1 << 20)


_REQ = """SELECT request_id, 'https://host/f' || scan_id AS url, CASE WHEN request_id % 5 <> 0 THEN bytes END AS lo, CASE WHEN request_id % 5 <> 0 THEN bytes + 100 END AS hi, scan_id % 4 <> 1 AS pinned, cached, bytes FROM log"""
_KEY = "sha256(url || '#' || CASE WHEN lo IS NULL THEN 'all' ELSE lo || '-' || hi END)"


def requests(spark, sf):
    log = b.fetch_log(spark, sf)
    part = F.col("request_id") % 5 != 0
    return log.select("request_id", F.concat(F.lit("https://host/f"), F.col("scan_id").cast("string")).alias("url"), F.when(part, F.col("bytes")).alias("lo"),
                      F.when(part, F.col("bytes") + 100).alias("hi"), (F.col("scan_id") % 4 != 1).alias("pinned"), "cached", "bytes")


@query("b13_cache_split", b.with_sql(["log"], f"""SELECT request_id, r.key, r.pinned AND c.key IS NOT NULL AS hit, cached_bytes FROM (SELECT *, {_KEY} AS key FROM ({_REQ})) r
  LEFT JOIN (SELECT {_KEY} AS key, max(bytes) AS cached_bytes FROM ({_REQ}) WHERE cached GROUP BY key) c ON c.key = r.key"""))
def _(spark, sf):
    r = requests(spark, sf)
    cache = r.where("cached").groupBy(ct.cache_key(F.col("url"), F.col("lo"), F.col("hi")).alias("key")).agg(F.max("bytes").alias("bytes"))
    return ct.split_cached(r, cache).select("request_id", "key", "hit", "cached_bytes")


@query("b14_fetch_ledger", b.with_sql(["log"], """SELECT scan_id, network_bytes, cached_bytes, requests, round(network_bytes / nullif(CASE WHEN scan_id % 7 = 0 THEN 0 ELSE 1000000 END, 0), 6) AS fetched_fraction FROM (
  SELECT scan_id, coalesce(sum(bytes) FILTER (NOT cached), 0)::BIGINT AS network_bytes, coalesce(sum(bytes) FILTER (cached), 0)::BIGINT AS cached_bytes, count(*) FILTER (NOT cached) AS requests FROM log GROUP BY scan_id)"""))
def _(spark, sf):
    out = ct.ledger(b.fetch_log(spark, sf), ["scan_id"])
    weight = F.when(F.col("scan_id") % 7 == 0, 0).otherwise(1000000)
    return out.select("scan_id", "network_bytes", "cached_bytes", "requests", F.round(ct.fetched_fraction(F.col("network_bytes"), weight), 6).alias("fetched_fraction"))


_UNITS = ["GiB", " mib", "KiB", "GB", "g", "MB", "M", "kb", "K", "B", "", "x"]
_SIZE = f"concat((p_partkey % 50) / 4.0::DOUBLE, ' ', {_UNITS}[1 + p_partkey % 12])"
_MULT = "CASE " + " ".join(f"WHEN t LIKE '%{u}' THEN CAST(trunc(try_cast(left(t, length(t) - {len(u)}) AS DOUBLE) * {m}) AS BIGINT)" for u, m in ct.SIZE_UNITS) + " ELSE try_cast(CASE WHEN contains(t, '.') THEN NULL ELSE t END AS BIGINT) END"


@query("b15_byte_sizes", f"SELECT p_partkey, {_MULT} AS bytes FROM (SELECT p_partkey, replace(upper({_SIZE}), ' ', '') AS t FROM part)")
def _(spark, sf):
    p = table(spark, sf, "part")
    unit = F.element_at(F.array(*[F.lit(u) for u in _UNITS]), (1 + F.col("p_partkey") % 12).cast("int"))
    text = F.concat(((F.col("p_partkey") % 50) / 4.0).cast("string"), F.lit(" "), unit)
    return p.select("p_partkey", ct.parse_bytes(text).alias("bytes"))
