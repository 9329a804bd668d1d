import random
import re
from collections import Counter, defaultdict

import pytest

from palimpsest.llm import bound_collocations as phrases

from .helpers import corpus


def brute(rows, places, least):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, 5):
                counts[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        lost = {p[i : i + n] for p, e in frequent.items() for n in range(2, len(p)) for i in range(len(p) - n + 1) if 100 * e >= 80 * f[p[i : i + n]]}
        found = []
        for p, a in frequent.items():
            if p not in lost:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:places], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def texts(seed, n=150):
    rng = random.Random(seed)
    words = ["a", "b", "C", "é", "dd", "e-f", "g"]
    weights = [9, 6, 4, 3, 2, 1, 1]
    fixed = ["x y z w", "x y", "q b a q", "u v w x y"]
    make = lambda: rng.choice([" ", "  ", "\t", ". ", "\n"]).join(rng.choice(fixed) if rng.random() < 0.2 else rng.choices(words, weights)[0] for _ in range(rng.randint(0, 30)))
    return [(rng.choice(["en", "en", "en", "fr", None, ""]), make()) for _ in range(n)] + [("en", None), ("lone", "a"), (None, "")]


@pytest.mark.parametrize("places,least,depth", [(2000, 3, 4), (5, 2, 1), (12, 2, 2), (3, 4, 1)])
def test_collocations_equal_brute_force(spark, monkeypatch, places, least, depth):
    monkeypatch.setattr(phrases, "DEPTH", max(2, depth) if depth > 1 else 2)
    if depth == 1:
        monkeypatch.setattr(phrases, "MOST_NUMBERS", 5)  # stretches and renewed dictionaries
        monkeypatch.setattr(phrases, "CHUNK", 40)
        monkeypatch.setattr(phrases, "MOST_PHRASES", 6)
    rows = texts(places)
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, text string, f int, phrase int").repartition(3)
    assert got(phrases.collocations(docs, places, least)) == brute(rows, places, least)


def test_words_of_one_hash_stay_apart(monkeypatch):
    """Every word hashes alike, yet words keep their own numbers."""
    monkeypatch.setattr(phrases, "_hashes", lambda prefix, lo, hi: (hi - hi).astype("uint64"))
    words = phrases._Words()
    text = b"aa bb.aa  b bb a"
    assert [words.spelled[c] for c in words.numbers(text)] == [b"aa", b"bb", b".", b"aa", b"b", b"bb", b"a"]
    assert [words.spelled[c] for c in words.numbers(b"..bb.. cc ")] == [b"bb", b".", b"cc"]


def test_stretches_hold_every_phrase_once(monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 7)
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("ab  .cd") for _ in range(rng.randint(0, 80))).encode()
        for length in (1, 2, 4):
            got, want = Counter(), Counter()
            for out, parts in ((got, phrases._stretches(text, length)), (want, [text])):
                for part in parts:
                    for piece in part.split(b"."):
                        words = piece.split()
                        out.update(tuple(words[i : i + length]) for i in range(len(words) - length + 1))
            assert got == want, (text, length)


def test_missing_tails_are_counted(spark):
    """Four words that stick together although the last three alone are common with weak pairs."""
    rows = [("en", "p q r s")] * 8 + [("en", "q r s")] * 3 + [("en", t) for t in ["q r", "r s", "q x", "x s", "y z"] for _ in range(6)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    for places in (2, 50):
        assert got(phrases.collocations(docs, places, 2)) == brute(rows, places, 2)


def test_whole_corpus_and_empty_table(spark):
    rows = [(r[2], r[1]) for r in corpus(n=20)]
    assert got(phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), 2000, 5)) == brute(rows, 2000, 5)
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
