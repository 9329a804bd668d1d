"""Registered queries: files derived from the tables, reports and live jobs."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from palimpsest.functions import keyed
from palimpsest.operators import heat
from palimpsest.plans import bindings as b
from palimpsest.plans import heat_queries as hq
from palimpsest.plans import probe_queries as pq
from palimpsest.plans.registry import query, table
from palimpsest.session import scratch_path
from palimpsest.sources import media, tensor_files
from palimpsest.streaming import live


def tensor_folder(spark, sf):
    """One tensor file per vector (F32 [8, 8] and F16 [64]), written by the tasks that hold the vectors."""
    folder = scratch_path(spark, "tensor-files")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for pdf in batches:
            names, contents = [], []
            for vec_id, v in zip(pdf["vec_id"], pdf["v"]):
                body = np.asarray(v, "<f4").tobytes() + np.asarray(v, "<f2").tobytes()
                head = json.dumps({"__metadata__": {"vec": str(vec_id)}, "w": {"dtype": "F32", "shape": [8, 8], "data_offsets": [0, 256]},
                                   "h": {"dtype": "F16", "shape": [64], "data_offsets": [256, 384]}}).encode()
                names.append(f"v{vec_id}.safetensors")
                contents.append(struct.pack("<Q", len(head)) + head + body)
            yield pd.DataFrame({"name": names, "content": contents})

    rows = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<float>").alias("v"))
    tensor_files.write_files(rows.mapInPandas(build, "name string, content binary"), folder)
    return folder


def adapter_folder(spark, sf):
    """A folder per supplier with an empty tensor file and, for all but every fourth, a config beside it."""
    folder = scratch_path(spark, "adapters")
    k = F.col("s_suppkey").cast("string")
    head = F.concat(F.lit('{"w'), k, F.lit('": {"dtype": "F32", "shape": [0, 4], "data_offsets": [0, 0]}}'))
    size = F.concat(F.lower(F.lpad(F.hex(F.length(head)), 2, "0")), F.lit("00000000000000"))
    tensors = table(spark, sf, "supplier").select(F.concat(F.lit("s"), k, F.lit("/m.safetensors")).alias("name"), F.concat(F.unhex(size), head.cast("binary")).alias("content"))
    configs = table(spark, sf, "supplier").where("s_suppkey % 4 > 0").select(
        F.concat(F.lit("s"), k, F.lit("/adapter_config.json")).alias("name"), F.concat(F.lit('{"r": '), (F.col("s_suppkey") % 16).cast("string"), F.lit("}")).cast("binary").alias("content"))
    tensor_files.write_files(tensors.unionByName(configs), folder)
    return folder


def shard_folder(spark, sf):
    """A shard index per nation that names a shard per supplier; one nation's is no JSON."""
    folder = scratch_path(spark, "shards")
    entry = F.concat(F.lit('"t'), F.col("s_suppkey").cast("string"), F.lit('": "'), (F.col("s_suppkey") % 5).cast("string"), F.lit('.safetensors"'))
    listed = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.array_join(F.sort_array(F.collect_list(entry)), ", ").alias("e"))
    text = F.when(F.col("s_nationkey") == 3, "not json").otherwise(F.concat(F.lit('{"weight_map": {'), "e", F.lit("}}")))
    tensor_files.write_files(listed.select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit(".safetensors.index.json")).alias("name"), text.cast("binary").alias("content")), folder)
    return folder


_HEADER = "length(concat('{\"__metadata__\": {\"vec\": \"', vec_id, '\"}, \"w\": {\"dtype\": \"F32\", \"shape\": [8, 8], \"data_offsets\": [0, 256]}, \"h\": {\"dtype\": \"F16\", \"shape\": [64], \"data_offsets\": [256, 384]}}'))"


@query("a1_tensor_header_scan", f"""SELECT 'v' || vec_id || '.safetensors' AS file, n AS name, t AS dtype, s AS shape, 8 + {_HEADER} + a AS byte_start, 8 + {_HEADER} + e AS byte_end, vec_id::VARCHAR AS vec
  FROM embeddings, (VALUES ('w', 'F32', '8x8', 0, 256), ('h', 'F16', '64', 256, 384)) v(n, t, s, a, e)""")
def _(spark, sf):
    out = tensor_files.scan_headers(spark, tensor_folder(spark, sf))
    return out.select(F.regexp_extract("path", "([^/]*)$", 1).alias("file"), "name", "dtype", F.array_join(F.col("shape").cast("array<string>"), "x").alias("shape"),
                      "byte_start", "byte_end", F.col("metadata")["vec"].alias("vec"))


@query("a4_payload_decode", "SELECT vec_id, round(sum(embedding[i]::FLOAT::DOUBLE), 6) AS total, count(*) AS n FROM embeddings, range(1, 65) t(i) GROUP BY vec_id")
def _(spark, sf):
    heads = tensor_files.scan_headers(spark, tensor_folder(spark, sf)).where("name = 'w'")
    out = tensor_files.decode_payloads(heads)
    return (out.groupBy(F.regexp_extract("path", r"v(\d+)\.", 1).cast("bigint").alias("vec_id")).agg(F.round(F.sum("value"), 6).alias("total"), F.count(F.lit(1)).alias("n")))


@query("a2_shard_index", "SELECT DISTINCT 'n' || s_nationkey || '.safetensors' AS unit, s_suppkey % 5 || '.safetensors' AS shard FROM supplier WHERE s_nationkey <> 3")
def _(spark, sf):
    name = lambda c: F.regexp_extract(c, "([^/]*)$", 1).alias(c)
    return tensor_files.shard_index(spark, shard_folder(spark, sf)).select(name("unit"), name("shard"))


_EMPTY_TENSOR = """'{"w' || s_suppkey || '": {"dtype": "F32", "shape": [0, 4], "data_offsets": [0, 0]}}'"""


@query("a5_local_adapters", f"""SELECT 's' || s_suppkey AS folder, 'w' || s_suppkey AS name, 'sha256:' || sha256(unhex(printf('%02x', length({_EMPTY_TENSOR})) || '00000000000000') || encode({_EMPTY_TENSOR})) AS pin,
  CASE WHEN s_suppkey % 4 > 0 THEN '{{"r": ' || s_suppkey % 16 || '}}' END AS config FROM supplier""")
def _(spark, sf):
    out = tensor_files.local_adapters(spark, adapter_folder(spark, sf))
    return out.select(F.regexp_extract("path", "([^/]*)/[^/]*$", 1).alias("folder"), "name", "pin", "config")


@query("a8_report_round_trip")
def _(spark, sf):
    """MEAS reports written as partitioned parquet, read back and rendered as JSON."""
    m, cells, stats = pq.regions(spark, sf)
    created = table(spark, sf, "events").agg(F.max("ts").alias("t")).scalar().cast("timestamp")
    snaps = pq.probe.membership_snap(pq.probe.confirmation_distances(pq.meas(spark, sf), pq.KEYS), cells, pq.KEYS)
    heads = snaps.select("ref_id", "membership_snap", "frame_snap", F.lit("memorized").alias("verdict"), F.array(F.lit("fixture")).alias("reasons"))
    layers = pq.probe.layers(m, pq.fields(spark, sf), cells, pq.KEYS)
    reports = media.assemble_reports(heads, stats, layers, pq.KEYS, created)
    path = scratch_path(spark, "reports")
    media.write_reports(reports, path)
    return media.report_json(media.read_reports(spark, path), pq.KEYS)


@query("a10_overlay_sink", b.with_sql(["emb"], "") + f", {hq._SAMPLE}, {hq._COLORED} SELECT ref_id, count(*) AS pixels FROM col GROUP BY ref_id")
def _(spark, sf):
    out = heat.overlay(hq.pixels(spark, sf), b.latents(spark, sf), None, ["ref_id"], hq.FRAME, 8, 8, 0.1).withColumn("ref_id", F.col("ref_id"))
    path = scratch_path(spark, "overlay")
    media.write_overlay(out.withColumn("part", F.col("ref_id") % 16).drop("c", "value"), path, "part")
    return spark.read.parquet(path).groupBy("ref_id").agg(F.count(F.lit(1)).alias("pixels"))


_REPORT = """SELECT run_id AS ref_id, verdict, coalesce(found, 0)::BIGINT AS regions, round(coalesce(mass_sum, 0), 6) AS region_mass, n_controls AS controls, round(masses_sum, 6) AS control_mass,
  levels::BIGINT AS levels, round(coalesce(released, 0), 6) AS released, round(coalesce(mc, 0), 6) AS mean_collapse, round(coalesce(ls, 0), 4) AS level_snap, 'base-samples' AS source, 'toy' AS profile,
  substr(sha256('{key}'), 1, 16) AS schedule_id, substr(sha256(concat_ws('|', 'toy', 0, run_id, win_lo, win_hi, substr(sha256('{key}'), 1, 16))), 1, 32) AS report_id,
  round(layer_sum, 6) AS layer_sum, false AS calibrated FROM judged
  LEFT JOIN (SELECT tid AS t1, sum(mass) AS mass_sum FROM cal GROUP BY tid) r ON t1 = tid
  LEFT JOIN (SELECT win_lo AS w1, win_hi AS w2, list_sum(masses) AS masses_sum FROM nulls) v ON w1 = win_lo AND w2 = win_hi
  LEFT JOIN (SELECT ref_id AS t2, sum(rf) AS released, sum(mc) AS mc FROM (SELECT ref_id, level_ix, avg(released::INT::DOUBLE) AS rf, coalesce(avg(c) FILTER (released), 0) AS mc FROM gated GROUP BY ref_id, level_ix) GROUP BY ref_id) l ON t2 = tid
  LEFT JOIN (SELECT ref_id AS t3, sum(snap) AS ls FROM (SELECT ref_id, level_ix, exp(avg(lr)) AS snap FROM lr GROUP BY ref_id, level_ix) GROUP BY ref_id) k ON t3 = tid
  LEFT JOIN (SELECT ref_id AS t4, sum(s) AS layer_sum FROM maps GROUP BY ref_id) y ON t4 = tid"""


@query("k12_report_assembly", pq.calibrated_sql(_REPORT.replace("{key}", keyed.RESEARCH_KEY.decode())))
def _(spark, sf):
    """Calibrated reports as JSON text, read back: ids, schedule, controls, levels, regions and layers."""
    a = pq.emb_audit(spark, sf, pq.CAL, pq.CAL_LEVELS, scout=True, controls=pq.CONTROLS)
    details = pq.audit.report_details(a, pq.CAL_LEVELS, pq.CAL.profile)
    reports = media.assemble_reports(a.verdicts, a.regions, pq.audit.heat_layers(a, b.CELLS), pq.audit.TEST, F.to_timestamp(F.lit("2024-01-01 00:00:00")), details)
    text = media.report_json(reports, ["ref_id"])
    shape = ("verdict string, report_id string, schedule_id string, profile string, calibrated boolean, disclaimer string, regions array<struct<mass:string>>, layers array<struct<layer:string,values:array<string>>>, "
             "controls struct<source:string,count:bigint,max_masses:array<double>>, levels array<struct<released_fraction:double,mean_collapse:double,snap:double>>")
    r = text.select("ref_id", F.from_json("report", shape).alias("r")).select("ref_id", "r.*")
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, v: s + v.cast("double"))
    raw = F.filter("layers", lambda x: x["layer"] == "collapse-raw")[0]["values"]
    listed = F.coalesce("regions", F.array().cast("array<struct<mass:string>>"))
    return r.where("length(disclaimer) > 0").select(
        "ref_id", "verdict", F.size(listed).cast("bigint").alias("regions"), F.round(total(F.transform(listed, lambda x: x["mass"])), 6).alias("region_mass"),
        F.coalesce("controls.count", F.lit(0)).cast("bigint").alias("controls"), F.round(total(F.col("controls.max_masses")), 6).alias("control_mass"),
        F.size("levels").cast("bigint").alias("levels"), *[F.round(total(F.col(f"levels.{c}")), 4 if c == "snap" else 6).alias(out)
                                                          for c, out in (("released_fraction", "released"), ("mean_collapse", "mean_collapse"), ("snap", "level_snap"))],
        "controls.source", "profile", "schedule_id", "report_id", F.round(total(raw), 6).alias("layer_sum"), "calibrated")


# --- L: live jobs -----------------------------------------------------------

def log_stream(spark, sf):
    ev = live.stream_table(spark, sf, "events")
    return ev.select(F.col("event_id").alias("request_id"), (F.col("user_id") % 20).alias("scan_id"), F.col("ts").cast("timestamp").alias("ts"),
                     F.round(F.col("value") * 1000).cast("bigint").alias("bytes"), (F.col("user_id") % 3 == 0).alias("cached"), "event_type")


@query("l1_live_ledger", b.with_sql(["log"], """SELECT scan_id, coalesce(sum(bytes) FILTER (NOT cached), 0)::BIGINT AS network_bytes, coalesce(sum(bytes) FILTER (cached), 0)::BIGINT AS cached_bytes,
  count(*) FILTER (NOT cached) AS requests FROM log GROUP BY scan_id"""))
def _(spark, sf):
    out = live.run_to_table(live.live_ledger(log_stream(spark, sf), ["scan_id"]), "update")
    cols = ["network_bytes", "cached_bytes", "requests"]
    return out.groupBy("scan_id").agg(F.max_by(F.struct(*cols), "batch").alias("v")).select("scan_id", "v.*")


@query("l1_windowed_ledger", b.with_sql(["log"], """SELECT scan_id, CAST(epoch(hour) AS BIGINT) AS hour, coalesce(sum(bytes) FILTER (NOT cached), 0)::BIGINT AS network_bytes, coalesce(sum(bytes) FILTER (cached), 0)::BIGINT AS cached_bytes,
  count(*) FILTER (NOT cached) AS requests FROM (SELECT *, date_trunc('hour', ts) AS hour FROM log) WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM log) GROUP BY scan_id, hour"""))
def _(spark, sf):
    """The ledger of every hour the watermark has closed, each told once."""
    out = live.run_to_table(live.windowed_ledger(log_stream(spark, sf), ["scan_id"]))
    return out.select("scan_id", F.col("window.start").cast("bigint").alias("hour"), "network_bytes", "cached_bytes", "requests")


_STEP = f"(phase <> shown OR phase <> 'fetching' AND detail <> last OR phase = 'fetching' AND (detail <> '' AND detail <> last OR size - seen >= {live.STEP}))"


@query("l2_quiet_progress", f"""WITH RECURSIVE ev AS MATERIALIZED (SELECT user_id % 20 AS scan_id, event_id AS seq, CASE WHEN event_type IN ('click', 'view') THEN 'fetching' ELSE event_type END AS phase,
    CASE WHEN user_id % 3 = 0 THEN '' ELSE 'u' || event_id % 3 END AS detail, event_id * 100000 AS size, row_number() OVER (PARTITION BY user_id % 20 ORDER BY epoch_ms(ts), event_id) AS i
    FROM events WHERE ts < date_trunc('minute', (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE)),
  walk AS (SELECT scan_id, 0::BIGINT AS i, NULL::BIGINT AS seq, NULL::VARCHAR AS phase, NULL::VARCHAR AS detail, NULL::BIGINT AS size, '-' AS shown, '' AS last, 0::BIGINT AS seen, false AS news FROM (SELECT DISTINCT scan_id FROM ev)
    UNION ALL SELECT scan_id, i, seq, phase, detail, size, CASE WHEN news THEN phase ELSE shown END, CASE WHEN news AND detail <> '' THEN detail ELSE last END, CASE WHEN news THEN size ELSE seen END, news FROM (
      SELECT e.*, w.shown, w.last, w.seen, {_STEP.replace('phase', 'e.phase').replace('detail', 'e.detail').replace('size', 'e.size')} AS news FROM walk w JOIN ev e ON e.scan_id = w.scan_id AND e.i = w.i + 1))
  SELECT scan_id, seq, phase, detail, size AS bytes FROM walk WHERE news""")
def _(spark, sf):
    """Progress worth showing, in event-time order, up to the last minute the watermark has passed."""
    ev = log_stream(spark, sf)
    phase = F.when(F.col("event_type").isin("click", "view"), "fetching").otherwise(F.col("event_type"))
    rows = ev.select("scan_id", F.col("request_id").alias("seq"), "ts", phase.alias("phase"), F.when(F.col("cached"), "").otherwise(F.concat(F.lit("u"), (F.col("request_id") % 3).cast("string"))).alias("detail"),
                     (F.col("request_id") * 100_000).alias("bytes"))
    return live.run_to_table(live.quiet_progress(rows)).select("scan_id", "seq", "phase", "detail", "bytes")


@query("l3_live_calibration", b.with_sql(["ctrl"], f"""SELECT run_id, id, p_value, CASE WHEN p_value > 0.05 THEN 'no-evidence' WHEN (id % 80) / 10.0 >= 4 THEN 'memorized' ELSE 'memorized-other-content' END AS verdict FROM (
  SELECT run_id, id, round((1 + n - below) / (1.0 + n), 6) AS p_value FROM (SELECT run_id, id, role, count(*) FILTER (role = 'control') OVER (PARTITION BY run_id) AS n,
  coalesce(count(*) FILTER (role = 'control') OVER (PARTITION BY run_id ORDER BY mass RANGE UNBOUNDED PRECEDING EXCLUDE TIES), 0) - CASE WHEN role = 'control' THEN 1 ELSE 0 END AS below FROM ctrl) WHERE role = 'reference')"""))
def _(spark, sf):
    orders = live.stream_table(spark, sf, "orders")
    arriving = orders.where("o_orderpriority <> '5-LOW'").select(F.col("o_orderstatus").alias("run_id"), F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1000).alias("mass"),
                                                                 ((F.col("o_orderkey") % 80) / 10.0).alias("snap"))
    controls = b.masses(spark, sf).where("role = 'control'").select("run_id", "mass")
    ranks = live.control_ranks(controls)
    out = live.run_to_table(arriving, each=lambda batch: live.live_calibration(batch, ranks))
    return out.select("run_id", "id", F.round("p_value", 6).alias("p_value"), "verdict")
