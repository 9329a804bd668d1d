import hashlib
import random

import pytest

from palimpsest.llm.cover_dedup import remove_repeats

from .helpers import SCHEMA, corpus, frame


def brute(rows, length):
    texts = [(r[1] or "").encode() for r in rows]
    seen = {}
    for t in texts:
        for s in range(len(t) - length + 1):
            seen[t[s : s + length]] = seen.get(t[s : s + length], 0) + 1
    out = []
    for r, t in zip(rows, texts):
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        runs = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((r[0] if r[0] is not None else -9, len(t), sum(gone), runs, kept, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def passages(seed=5):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    shared = [text(n) for n in (30, 60, 64, 65, 90, 150, 400)]
    rows = []
    for i in range(80):
        body = "".join(text(rng.randint(0, 120)) + rng.choice(shared) for _ in range(rng.randint(0, 4))) + text(rng.randint(0, 50))
        if rng.random() < 0.3 and rows:
            body = list(rng.choice(rows)[1])
            for _ in range(rng.randint(0, 3)):
                if body:
                    body[rng.randrange(len(body))] = "#"
            body = "".join(body)
        rows.append((i, body, "en", "s", 1))
    period = text(17)
    return rows + [(500, period * 30, None, None, None), (501, text(40) + period * 9, "en", "s", 0), (502, "z" * 300, "en", "s", 0), (None, shared[-1], "en", "s", 0), (None, text(80), "en", "s", 0)]


@pytest.mark.parametrize("hot", [20_000, 1])
def test_equals_brute_force(spark, hot):
    rows = passages() + corpus(n=25)
    got = remove_repeats(frame(spark, rows), length=64, hot=hot)
    assert sorted((r[0] if r[0] is not None else -9, *r[1:4], bytes(r.kept), r.kept_sha256) for r in got.collect()) == brute(rows, 64)


def test_slices_and_production_length(spark, monkeypatch):
    import palimpsest.llm.cover_dedup as m

    rows = passages(9)[:40] + corpus(4, 10)
    parts = [p for group in m._slices([r[1].encode() if r[1] else b"" for r in rows], 200) for p in group]
    assert sum(len(p[2]) for p in parts) >= sum(len((r[1] or "").encode()) for r in rows if len((r[1] or "").encode()) >= 200)
    got = remove_repeats(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", block long"), with_text=False)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == [(*b[:4], b[5]) for b in brute(rows, 200)]
    assert remove_repeats(frame(spark, [])).count() == 0


def test_long_text_in_slices(monkeypatch):
    import numpy as np

    import palimpsest.llm.cover_dedup as m

    monkeypatch.setattr(m, "SLICE", 500)
    rng = random.Random(1)
    text = bytes(rng.choice(b"abc ") for _ in range(3000))
    starts = []
    for parts in m._slices([text], 64):
        ends = np.cumsum([len(p[2]) for p in parts])
        for _, _, at, lo, hi in zip(*m.sampled_runs(np.frombuffer(b"".join(p[2] for p in parts), np.uint8), ends, 64)):
            k = int(np.searchsorted(ends, lo, side="right"))
            shift = parts[k][1] - (ends[k - 1] if k else 0)
            assert lo <= hi <= at <= lo + 32
            starts += range(lo + shift, hi + shift + 1)
    assert sorted(starts) == list(range(3000 - 63))
