import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import bracket_resampling as draw

from .helpers import corpus, frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, percent=10, least=20, longest=1, buckets=10_000, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for held, texts in ((s, [r[1] for r in rows]), (t, target)):
        for text in texts:
            for f in features(text, longest)[1]:
                held[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out = []
    for doc_id, text in rows:
        words, found = features(text, longest)
        weight = sum(gain[bucket(f)] for f in found)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(able):
        r.append(k + 1 if k < len(able) * percent // 100 else None)
    return sorted((tuple(r[:4]) + (r[5] if len(r) > 5 else None,) for r in out), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.mark.parametrize("longest,buckets,percent,margin", [(1, 10_000, 10, 0.004), (2, 97, 35, 0.0), (1, 10_000, 100, 0.004), (1, 10_000, 0, 0.004)])
def test_draw_equals_brute_force(spark, longest, buckets, percent, margin, monkeypatch):
    monkeypatch.setattr(draw, "RANK_ROWS", 7)  # many ranges
    rows = [(r[0], r[1]) for r in corpus(n=25)] + [(None, "word " * 30), (None, None)]
    target = ["Ab cd  12 é", None, "", corpus(n=2)[20][1]]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, score int, __range string").repartition(5)
    target_df = frame(spark, [(t,) for t in target], "text string")
    result = draw.resample(docs, target_df, percent, 20, longest, buckets, margin=margin)
    assert got(result) == brute(rows, target, percent, 20, longest, buckets)


def test_equal_scores_are_drawn_one_by_one(spark):
    rows = [(5, "a b c " * 10)] * 300 + [(i, "a b " * 12) for i in range(100)]
    result = draw.resample(frame(spark, rows, "doc_id long, text string"), frame(spark, [], "text string"), percent=50)
    assert sorted(r.rank for r in result.collect() if r.rank) == list(range(1, 201))
    assert got(result) == brute(rows, [], 50)


def test_a_bracket_that_misses_is_widened(spark, monkeypatch):
    scores = spark.range(1000).select((F.col("id") * 3).alias("score"))
    assert draw.bracket(scores, 10)[0] == 100
    real = F.percentile_approx
    calls = []

    def wrong(column, shares, accuracy):
        calls.append(shares)
        return real(column, shares if len(calls) > 3 else [0.0, 0.0], accuracy)

    monkeypatch.setattr(draw.F, "percentile_approx", wrong)
    wanted, low, high, above = draw.bracket(scores, 10)
    assert wanted == 100 and len(calls) == 4 and above <= 100 <= scores.where(F.col("score") >= low).count() and low <= high


def test_empty_tables(spark):
    none = frame(spark, [], "doc_id long, text string")
    assert draw.resample(none, frame(spark, [("a",)], "text string")).count() == 0
