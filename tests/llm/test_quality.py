import random
import zlib

import numpy as np

from palimpsest.llm import fourier_quality as q

from .helpers import SCHEMA, corpus, frame


def labelled(spark, n=600, seed=2):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("aeiountrs") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 80))]
        good = rng.random() < 0.7
        rows.append((i, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words), "en", "s", 0))
        labels.append((i, int(good)))
    rows += [(10_000 + r[0], *r[1:]) for r in corpus(n=5)]
    return rows, labels + [(3, labels[3][1]), (None, 1), (7, None), (99_999, 1)]


def test_held_out_rows_are_told_apart(spark):
    rows, labels = labelled(spark)
    docs = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", score int")
    got = q.score(docs, spark.createDataFrame(labels, "doc_id long, label int")).collect()
    assert len(got) == len(rows)
    truth = dict(labels[:600])
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 60 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_held_out_labels_change_nothing(spark):
    rows, labels = labelled(spark, 120)
    docs = frame(spark, rows)
    flipped = [(i, y if i is None or y is None or zlib.crc32(str(i).encode()) % 5 else 1 - y) for i, y in labels]
    a, b = (sorted((r.doc_id, round(r.score, 9)) for r in q.score(docs, spark.createDataFrame(x, "doc_id long, label int")).collect()) for x in (labels, flipped))
    assert a == b


def test_no_labels_and_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, label int")
    assert {r.score for r in q.score(frame(spark, corpus(n=3)), none).collect()} == {0.5}
    assert q.score(frame(spark, []), none).count() == 0


def test_isotonic_against_brute_force():
    rng = random.Random(4)
    rows = [(float(i), float(rng.randint(0, 5)), 5.0) for i in range(40)]
    starts, values = q._isotonic(rows)
    assert list(values) == sorted(values) and starts[0] == 0
    means = [max(min(sum(r[1] for r in rows[a : b + 1]) / (5 * (b - a + 1)) for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    for block, (start, value) in enumerate(zip(starts, values)):
        end = int(starts[block + 1]) if block + 1 < len(starts) else 40
        n = 5 * (end - int(start))
        assert abs((value * (n + 1) - 0.5) / n - means[int(start)]) < 1e-9
