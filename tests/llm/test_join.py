import random

import numpy as np
import pytest

from palimpsest.llm import part_enum
from palimpsest.llm.part_enum import Bands, class_id, join_components, keep_first, shingle_sets, signatures

from .helpers import SCHEMA, corpus, frame


def shingles(text, size=4):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())


def brute(rows, percent, size=4):
    sets = [shingles(r[1], size) for r in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                label[find(i)] = find(j)
    ids = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[find(i)] = min(ids.get(find(i), r[0]), r[0])
    return sorted((r[0] if r[0] is not None else -9, len(sets[i]), ids.get(find(i), -9) if sets[i] else (r[0] if r[0] is not None else -9)) for i, r in enumerate(rows))


def near_copies(seed=8, groups=6, members=25):
    """Groups whose members differ from a base and from each other by all degrees, a passage shared by many, and short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    passage = [word() for _ in range(40)]
    rows = []
    for g in range(groups):
        base = [word() for _ in range(rng.choice([6, 12, 40, 120, 300]))]
        for m in range(members):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 4, 6])):
                k, how = rng.randrange(len(w)), rng.random()
                if how < 0.5:
                    w[k] = word()
                elif how < 0.8 and len(w) > 2:
                    del w[k]
                else:
                    w.insert(k, word())
            if m % 6 == 5:  # a second centre away from the base
                w = w[: len(w) // 2] + base[: len(w) // 4] + w[len(w) // 2 :]
            rows.append((len(rows) * 3 % 1000, " ".join(w), "en", "s", 0))
    for _ in range(60):
        rows.append((2000 + len(rows), " ".join([word() for _ in range(rng.randint(0, 30))] + passage + [word() for _ in range(rng.randint(0, 30))]), "en", "s", 0))
    return rows


@pytest.mark.parametrize(("seed", "percent"), [(8, 85), (9, 85), (10, 70)])
def test_components_equal_brute_force(spark, seed, percent):
    rows = near_copies(seed) + [(9000 + r[0], *r[1:]) for r in corpus(seed, 25)] + [(None, "only one here without id at all yes", "en", "s", 0), (None, near_copies(seed)[0][1], "en", "s", 0)]
    got = join_components(frame(spark, rows), percent=percent)
    assert sorted((r[0] if r[0] is not None else -9, r[1], r[2] if r[2] is not None else -9) for r in got.collect()) == brute(rows, percent)


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(3)
    bands = Bands(85, part_enum.SPREAD)
    for n in [1, 2, 5, 6, 7, 8, 13, 20, 45, 100, 400, 1500]:
        for _ in range(12):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            differ = int(15 * n / 85)
            drop = int(rng.integers(0, differ + 1))
            add = int(rng.integers(0, differ - drop + 1))
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, add, dtype=np.uint64)]))
            shared = len(np.intersect1d(a, b))
            if len(b) and 100 * shared >= 85 * (len(a) + len(b) - shared):
                assert np.intersect1d(signatures(a, bands), signatures(b, bands)).size


def test_sets_of_words():
    texts = ["A b\x0bC d E", "one", "", " \n", "é É x y z", "a b c d a b c d", "x y"]
    for text, s in zip(texts, shingle_sets([t.encode() for t in texts])):
        assert len(s) == len(shingles(text))
    a, b = shingle_sets([b"A B C D", b"a  b\nc d"])
    assert class_id(a) == class_id(b)


def test_keep_first(spark):
    rows = near_copies(11, 2, 10) + [(3, None, "en", "s", 0), (3, "", "en", "s", 0)] + near_copies(11, 2, 10)[:4]
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA + ", n int, __kid int, __cls string")
    kept = keep_first(docs)
    assert kept.columns == docs.columns
    want = sorted({c for i, n, c in brute(rows, 85) if n})
    got = kept.collect()
    assert sorted(r.doc_id for r in got if shingles(r.text)) == want
    assert sum(not shingles(r.text) for r in got) == 2
    assert join_components(frame(spark, [])).count() == 0 and keep_first(frame(spark, [])).count() == 0
