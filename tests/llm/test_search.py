import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm.threshold_search import threshold_top_k, top_k


def brute(rows, k):
    import math

    kept = {}
    for vec_id, v in rows:
        if v and all(x is not None and math.isfinite(x) for x in v):
            kept[vec_id, tuple(math.floor(64 * x) for x in v)] = 1
    out = []
    for q, a in kept:
        if q % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in kept if i != q and len(a) == len(b))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("spread", [1, 100])
def test_one_block_with_ties(spread):
    rng = np.random.default_rng(spread)
    rows = rng.integers(-3, 4, (400, 6)) * spread
    ids = rng.permutation(400)
    got = threshold_top_k(ids, rows, ids[:30], rows[:30], 5, step=7)
    for q in range(30):
        want = sorted((-int(rows[q] @ r), int(i)) for i, r in zip(ids, rows) if i != ids[q])[:5]
        assert [(-s, i) for query, i, s in got if query == ids[q]] == want


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.3, 5)]) for i in range(150)]
    rows += [(200 + i, rows[40][1]) for i in range(30)] + [(300, None), (320, []), (340, [1.0, None, 0.0, 0.0, 0.0]), (360, [float("nan")] * 5), (380, [float("inf")] + [0.0] * 4), (400, [0.0] * 5), (420, [1.0, 2.0]), (421, [2.0, 2.0]), rows[3], rows[3], (440, [1e30, 0.0])]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, rank int")
    got = top_k(frame, F.col("vec_id") % 20 == 0, k=7, block=40, query_block=4)
    stored = [(r.vec_id, r.embedding) for r in frame.collect()]
    top = 2**63
    want = [(q, r, i, max(-top, min(top - 1, s))) for q, r, i, s in brute(stored, 7) if q != 440]
    assert sorted(tuple(x) for x in got.where("query_id <> 440").collect()) == [w for w in want]
    assert got.select("query_id", "rank").distinct().count() == got.count()
    assert top_k(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert top_k(frame.where("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0
