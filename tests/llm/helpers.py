"""A small corpus with every awkward case, and brute-force counterparts."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed: int = 3, n: int = 60) -> list[tuple]:
    """Prose with copies, near copies, repeated lines, nulls, empty and long texts and repeated rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioustrné") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    prose = lambda k: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ",", ".\n"]) for _ in range(k))
    shared = prose(60)
    texts = [None, "", " \n\t ", "one", "The END", "a b c d", "a b c d e", prose(9000), "x" * 3000, "ab " * 900, "line one here now\n" * 40]
    texts += [f"{prose(30)} {shared} {prose(30)}" for _ in range(5)]
    for _ in range(n):
        words = prose(rng.randint(5, 150)).split(" ")
        texts.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 3])):
            other = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                other[rng.randrange(len(other))] = rng.choice(vocabulary)
            texts.append(" ".join(other))
    texts += ["WORLD!! OF!! NOISE!! AND!! MORE!! " * 6, "α Σίσυφος ΣΑΣ", "é İstanbul ＡＢＣ ²³ don't we'll 'tis x's", "<|endoftext|> a <|startoftext|>b"]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s0", "s0", "s0", "s1", None]), len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[20], rows[20], rows[0]]


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)
