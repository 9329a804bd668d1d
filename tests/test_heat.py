"""Heatmap pixels: values against the formula, and joins that leave the driver alone."""

import math

from palimpsest.operators import heat

FRAME = (0.0, 0.0, 4.0, 4.0)


def test_sample_without_broadcast_equals_the_formula(spark):
    # ref 1 misses cell 5, ref 2 holds an unknown value, ref 3 has no pixel
    cells = {(r, c): float(r * c % 7) for r in (1, 2, 3) for c in range(16) if (r, c) != (1, 5)}
    cells[2, 6] = None
    maps = spark.createDataFrame([(*k, v) for k, v in cells.items()], "ref_id bigint, cell int, value double")
    pixels = heat.pixel_grid(spark.createDataFrame([(1,), (2,)], "ref_id bigint"), 9, 9, 2.0)
    out = heat.sample(pixels, maps, ["ref_id"], FRAME, 4, 4)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r["ref_id"], r["ox"], r["oy"]): r["value"] for r in out.collect()}
    want = {}
    for ref in (1, 2):
        for ox in range(8):
            for oy in range(8):
                gx, gy = (ox + 0.5) / 2 - 0.5, (oy + 0.5) / 2 - 0.5
                x0, y0 = math.floor(gx), math.floor(gy)
                total = 0.0
                for dy in (0, 1):
                    for dx in (0, 1):
                        w = (gy - y0 if dy else 1 - gy + y0) * (gx - x0 if dx else 1 - gx + x0)
                        total += w * (cells.get((ref, min(max(y0 + dy, 0), 3) * 4 + min(max(x0 + dx, 0), 3))) or 0.0)
                want[ref, ox, oy] = total
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_overlay_keeps_counted_cells_without_broadcast(spark):
    maps = spark.createDataFrame([(r, c, 0.5) for r in (1, 2) for c in range(16)], "ref_id bigint, cell int, value double")
    counted = maps.where("cell = ref_id + 4")
    pixels = heat.pixel_grid(maps.select("ref_id").distinct(), 4, 4, 1.0)
    out = heat.overlay(pixels, maps, counted, ["ref_id"], FRAME, 4, 4, 0.1)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r["ref_id"], r["ox"], r["oy"]) for r in out.collect()} == {(1, 1, 1), (2, 2, 1)}
