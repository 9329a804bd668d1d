import math
import re
import zlib
from collections import Counter

from palimpsest.llm import likelihood_rules as rules

from .helpers import SCHEMA, corpus, frame


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def grams(text, buckets):
    h = [zlib.crc32(t.encode()) for t in re.findall("[0-9A-Za-z\x80-\U0010ffff]+|[!-/:-@\\[-`{-~]+", text or "")]
    return [(a * 31 + b) % buckets for a, b in zip(h, h[1:])]


def brute(rows, trusted, buckets, threshold):
    raw, target = Counter(), Counter()
    for doc_id, text, *_ in rows:
        raw.update(grams(text, buckets))
        if doc_id in trusted:
            target.update(grams(text, buckets))
    r, t = sum(raw.values()), sum(target.values())
    weight = [math.floor((math.log((target[b] + 1) / (t + buckets)) - math.log((raw[b] + 1) / (r + buckets))) * 65536 + 0.5) if t else 0 for b in range(buckets)]
    out = []
    for doc_id, text, *_ in rows:
        counts = base(text)
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        g = grams(text, buckets)
        out.append((doc_id, *counts, failed, not failed and sum(weight[b] for b in g) >= threshold * len(g)))
    return sorted(out)


def test_judge_equals_brute_force(spark):
    rows = corpus() + [(700, "a b\x0bc\x0c d\r\n e f g h i j k #$ | <x>", "en", "s", 0), (701, "α β γ δ ε " * 4, "el", "s", 0), (702, "same line here\nsame line here\n\n \nother", "en", "s", 0)]
    labels = [(i, 1) for i in range(0, 60, 2)] + [(3, 0), (2, 1), (None, 1), (9999, 1)]
    trusted = spark.createDataFrame(labels, "doc_id long, quality int").where("quality = 1").select("doc_id")
    docs = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", kept int")
    want = brute(rows, {i for i, q in labels if q}, 512, -3000)
    assert sorted(tuple(r) for r in rules.judge(docs, trusted, 512, -3000).collect()) == want
    kept = rules.filter_documents(docs, trusted, 512, -3000)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [w[0] for w in want if w[-1]]
    assert 0 < sum(w[-1] for w in want) < len(want)


def test_without_trusted_documents_and_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long")
    for r in rules.judge(frame(spark, corpus(n=5)), none, 512).collect():
        assert r.kept == (not r.base_failed)
    assert rules.judge(frame(spark, []), none, 512).count() == 0


def test_all_trusted_documents_are_counted(spark):
    docs = spark.range(60_000).selectExpr("id as doc_id", "'a b' as text")
    assert {r.weight for r in rules.ratio_weights(docs, docs.select("doc_id"), 512).collect()} == {0}
