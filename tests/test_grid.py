import hmac
import hashlib
import math
import random

from pyspark.sql import functions as F

from palimpsest.functions import keyed
from palimpsest.functions.profiles import CUSTOM
from palimpsest.operators import components, grid, intervals, probe


def flood(cells, cols):
    cells, out = set(cells), {}
    for start in sorted(cells):
        if start in out:
            continue
        stack = [start]
        while stack:
            c = stack.pop()
            if c in out:
                continue
            out[c] = start
            near = [c - cols, c + cols] + ([c - 1] if c % cols else []) + ([c + 1] if c % cols < cols - 1 else [])
            stack += [n for n in near if n in cells]
    return out


def test_components_small_and_distributed_match_flood_fill(spark):
    rng = random.Random(3)
    masks = {k: [c for c in range(12 * 9) if rng.random() < 0.55] for k in range(4)}
    masks[9] = [r * 9 + c for r in range(12) for c in range(9) if r % 2 == 0 or c == (0 if r % 4 == 1 else 8)]  # a snake
    df = spark.createDataFrame([(k, c) for k, cells in masks.items() for c in cells], "k bigint, cell int")
    want = {(k, c): root for k, cells in masks.items() for c, root in flood(cells, 9).items()}
    for plan in (components.small_components, components.large_components):
        assert {(r["k"], r["cell"]): r["root"] for r in plan(df, ["k"], 9).collect()} == want


def test_box_mean_dense_equals_sparse(spark):
    df = spark.createDataFrame([(0, c, float((c * 37) % 11)) for c in range(30)], "k bigint, cell int, v double")
    dense = {r["cell"]: r["s"] for r in grid.box_mean(df, ["k"], {"v": "s"}, 5, 6, 1, dense=True).collect()}
    sparse = {r["cell"]: r["s"] for r in grid.box_mean(df, ["k"], {"v": "s"}, 5, 6, 1).collect()}
    assert all(abs(dense[c] - sparse[c]) < 1e-12 for c in range(30))


def test_t95_literal(spark):
    got = [r[0] for r in spark.createDataFrame([(7,), (0,), (17,), (25,), (99,)], "d int").select(grid.t95(F.col("d"))).collect()]
    assert got == [1.895, math.inf, 1.725, 1.697, 1.645]


def test_coalesce_literal_and_buckets_do_not_matter(spark):
    df = spark.createDataFrame([(0, 0, 10), (0, 12, 20), (0, 3000, 3010), (0, 5, 5)], "file int, lo bigint, hi bigint")
    for bucket in (4, 64, 1 << 20):
        got = sorted((r["lo"], r["hi"]) for r in intervals.coalesce_ranges(df, gap=16, bucket=bucket).collect())
        assert got == [(0, 20), (3000, 3010)]


def test_coalesce_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(f, lo, lo + rng.randint(0, 400)) for f in range(3) for lo in (rng.randint(0, 20000) for _ in range(200))]
    want = set()
    for f in range(3):
        last = None
        for lo, hi in sorted((lo, hi) for g, lo, hi in rows if g == f and hi > lo):
            if last and lo <= last[1] + 30:
                last[1] = max(last[1], hi)
            else:
                if last:
                    want.add((f, *last))
                last = [lo, hi]
        want.add((f, *last))
    df = spark.createDataFrame(rows, "file int, lo bigint, hi bigint")
    blocks = intervals.coalesce_ranges(df, gap=30, bucket=512)
    assert {tuple(r) for r in blocks.select("file", "lo", "hi").collect()} == want
    assert intervals.contain_ranges(df, blocks, bucket=512).count() == sum(hi > lo for _, lo, hi in rows)


def test_content_range_literals(spark):
    df = spark.createDataFrame([("bytes 0-7/12345",), ("bytes 5-9/*",), ("nonsense",)], "h string")
    got = [r[0] and tuple(r[0]) for r in df.select(intervals.parse_content_range(F.col("h"))).collect()]
    assert got == [(0, 7, 12345), (5, 9, None), None]


def test_prf_is_hmac_and_partitioning_does_not_matter(spark):
    want = {i: hmac.new(b"k" * 70, f"{keyed.VERSION}|noise|{i}".encode(), hashlib.sha256).hexdigest() for i in range(20)}
    df = spark.range(20).repartition(7)
    assert {r["id"]: r["h"] for r in df.select("id", keyed.prf_hex("noise", F.col("id"), b"k" * 70).alias("h")).collect()} == want
    levels = keyed.level_table(spark, [1.0, 2.5])
    few = {(r["level"], r["draw"], r["cell"]): r["eps"] for r in keyed.draws(levels, 2, 9, "noise").repartition(5).collect()}
    many = {(r["level"], r["draw"], r["cell"]): r["eps"] for r in keyed.draws(levels, 6, 9, "noise").collect()}
    assert all(many[k] == v for k, v in few.items())
    other = keyed.draws(levels, 2, 9, "confirmation").first()["eps"]
    assert other not in few.values()


def test_single_level_uses_that_level(spark):
    rows = [(0, 3, c, 0.2 + c / 10, 0.01, 8, 0.9, c != 1) for c in range(3)]
    gated = spark.createDataFrame(rows, "ref_id bigint, level_ix int, cell int, c double, lower double, draws int, rho_base double, released boolean")
    got = {r["cell"]: r["s"] for r in probe.sustain(gated, ["ref_id"]).collect()}
    assert got[1] == 0.0 and abs(got[2] - 0.4) < 1e-12


def test_four_controls_cannot_be_significant(spark):
    regions = spark.createDataFrame([(0, 1, 1, 50.0)], "run bigint, ref_id bigint, region int, mass double")
    for n, p, label in ((19, 0.05, "significant"), (4, 0.2, "not-significant")):
        summary = spark.createDataFrame([(0, -k, "control", 1.0) for k in range(1, n + 1)], "run bigint, ref_id bigint, role string, max_mass double")
        row = probe.calibrate(regions, summary, ["run"], ["run", "ref_id"], CUSTOM).first()
        assert (round(row["p_value"], 6), row["significance"]) == (p, label)


def test_membership_snap_falls_back_to_the_frame(spark):
    rows = [(k, lv, c, 4.0 if c == 0 else 1.0, 1.0) for k in (0, 1) for lv in (0, 1) for c in range(4)]
    d = spark.createDataFrame(rows, "k bigint, level_ix int, cell int, d_base double, d_target double")
    cells = spark.createDataFrame([(1, 0)], "k bigint, cell int")
    got = {r["k"]: (round(r["membership_snap"], 9), round(r["frame_snap"], 9)) for r in probe.membership_snap(d, cells, ["k"]).collect()}
    frame = round(4.0 ** 0.25, 9)
    assert got == {0: (frame, frame), 1: (4.0, frame)}


def test_sustained_level_ignores_rounding_noise(spark):
    noise = 1.1e-16
    # cell 0: pairs tie but for noise, and so do their members; cell 1: the second pair is truly higher
    c = {0: [0.5, 0.5 + noise, 0.5 + 2 * noise, 0.5 + 4 * noise], 1: [0.5, 0.5, 0.5001, 0.5001]}
    rows = [("a", level, cell, True, v, v) for cell, values in c.items() for level, v in enumerate(values, 1)]
    out = probe.sustain(spark.createDataFrame(rows, "ref_id string, level_ix int, cell int, released boolean, c double, lower double"), ["ref_id"])
    assert {r["cell"]: r["s_level"] for r in out.collect()} == {0: 1, 1: 3}


def test_peak_level_ignores_rounding_noise(spark):
    rows = [("a", 1, 0, 0.3), ("a", 1, 1, 0.0), ("a", 2, 0, 0.1), ("a", 2, 1, 0.2), ("a", 3, 0, 0.1), ("a", 3, 1, 0.1)]
    cells = spark.createDataFrame([("a", 0, 0), ("a", 0, 1)], "ref_id string, root int, cell int")
    fields = spark.createDataFrame(rows, "ref_id string, level_ix int, cell int, c double")
    assert 0.1 + 0.2 > 0.3
    assert [r["peak_level"] for r in probe.peak_levels(cells, fields, ["ref_id"]).collect()] == [1]
