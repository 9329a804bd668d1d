"""A sample of registered queries beside DuckDB on the smallest tables."""

import os
import random
from decimal import ROUND_HALF_UP, Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import probe
from palimpsest.plans.catalog import ORACLE, QUERIES
from tools.compare import compare, oracle_connection

SF = "/root/testdata/sf0.001"
SAMPLE = ["b1_model_links", "b7_variant_dedupe", "b11_coalesce_ranges", "c2_layout", "c8_loha_update", "d2_tag_histogram", "e4_keyed_normals",
          "f6_component_distance", "g6_components", "h13_sustained_collapse", "h27_exceedance", "i3_photo_scale", "j6_overlay_pixels", "k6_group_summary"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_oracle(spark, name):
    ok, message = compare(spark, oracle_connection(SF), QUERIES[name], ORACLE[name], SF)
    assert ok, message


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_blocks_of_equal_ranges_do_not_depend_on_row_order(tmp_path):
    """Every block opens with many equal ranges; whichever the engine meets first, blocks stay apart."""
    con = duckdb.connect()
    con.execute("CREATE TABLE lineitem AS SELECT 10 * (k % 7) AS l_suppkey, 5 * k AS l_orderkey, 1 AS l_linenumber, 1.0 AS l_quantity FROM range(20000) t(k), range(12) ORDER BY random()")
    blocks = con.execute(f"SELECT count(*), max(hi - lo) FROM ({ORACLE['b11_coalesce_ranges']})").fetchall()
    assert blocks == [(20000, 20)]


def test_reasons_round_numbers_as_written(spark):
    """451930.5 / 7000 is 64.5615, whose double lies below the half."""
    row = "SELECT 1::BIGINT AS o_orderkey, 6::BIGINT AS o_custkey, 451930.5::DOUBLE AS o_totalprice, '2-HIGH' AS o_orderpriority"
    con = duckdb.connect()
    con.execute(f"CREATE TABLE orders AS {row}")
    (_, _, told), = con.execute(ORACLE["h29_verdict"]).fetchall()
    reasons = spark.sql("SELECT array(named_struct('code', 'x', 'arguments', array(64.5615D, -64.5615D, 1e-5D))) AS r").select(probe.reasons_text(F.col("r"))).first()[0]
    assert reasons == "x 64.562 -64.562 0.000" and "64.562" in told


def test_ties_at_the_tenth_place_round_by_one_rule(spark, tmp_path):
    """Means of 2^k rows end in a 5 at the tenth place; the noise of their sums must not choose the ninth, in the query or its SQL."""
    rng, rows, lower, prompt = random.Random(7), [], {}, {}
    for part in range(256):
        # three draws alike, one off by an odd number of hundredths: their standard error is a decimal
        m, d = 8 if part < 128 else 16, 2 * rng.randrange(-5, 5) + 1
        same = [(rng.randrange(11), rng.randrange(2, 5), rng.randrange(1, 51)) for _ in range(m)]
        last = [(q, t - (d if i == 0 else 0), n) for i, (q, t, n) in enumerate(same)]
        last[1] = (*last[1][:2], last[1][2] + 1)
        for draw, of in enumerate((same, same, same, last)):
            rows += [(part, part, draw, 1, float(n), q / 100, t / 100) for q, t, n in rng.sample(of, m)]
        row, col = part // 16, part % 16
        drop = Decimal("0.5") if 3 <= row <= 7 and 3 <= col <= 8 else Decimal("0.2") if 11 <= row <= 13 and 10 <= col <= 14 else Decimal(0)
        x, target = (sum(v[i] for v in [*same * 3, *last]) for i in (0, 1))
        c = Decimal("0.0032") + Decimal(x - target) / (400 * m) + drop
        lower[part] = c - Decimal("2.353") * Decimal(abs(d)) / (400 * m)
        prompt[part] = Decimal("0.6") - Decimal("0.8568") + drop - Decimal("0.04") + Decimal(sum(v[2] for v in [*same * 3, *last])) / (320 * m) - Decimal(target) / (400 * m)
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    for name, column, want in (("h12_lower_bound", "lower", lower), ("h6_channel_field", "c_prompt", prompt)):
        assert sum(abs(v) * 10**10 % 10 == 5 for v in want.values()) >= 60
        ok, message = compare(spark, con, QUERIES[name], ORACLE[name], str(tmp_path))
        assert ok, f"{name}: {message}"
        got = {r["cell"]: r[column] for r in QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == {k: float(v.quantize(Decimal("1e-9"), ROUND_HALF_UP)) for k, v in want.items()}
