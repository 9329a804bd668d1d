import hashlib
from collections import defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from palimpsest.llm.tree_mixing import leaf_budgets, mix, shares

LEVELS = ["domain", "lang", "source"]
SCHEMA = "doc_id long, domain string, lang string, source string, n_tokens long, epoch int"


def documents(n=400):
    rows = []
    for i in range(n):
        h = int(hashlib.md5(str(i).encode()).hexdigest(), 16)
        domain, lang, source = ("d0", "en", "hot") if h % 3 == 0 else (f"d{h % 2}", ["en", "fr", None][h // 7 % 3], ["s0", "s1", None, "n"][h // 31 % 4])
        rows.append((i, domain, lang, source, [0, 1, 5, 40, None, 900][h // 101 % 6], 0))
    return [*rows, rows[5], rows[5], (1000, "d9", "xx", "empty", 0, 0), (1001, "d9", "xx", "empty", None, 0), (None, "d1", "fr", "s0", 7, 0)]


def budgets(rows, total, max_epochs, weights):
    """Top-down water-filling in exact fractions."""
    size = defaultdict(int)
    for r in rows:
        size[r[1:4]] += r[4] or 0
    text = lambda v: "n" if v is None else "v" + v
    out = {}

    def divide(prefix, budget, k):
        kids = sorted({p[: k + 1] for p in size if p[:k] == prefix}, key=lambda p: "\x1f".join(map(text, p)))
        cap = {p: max_epochs * sum(n for q, n in size.items() if q[: k + 1] == p) for p in kids}
        w = {p: weights.get(LEVELS[k], {}).get(p[k], 1) for p in kids}
        open_, got, left = [p for p in kids if w[p]], dict.fromkeys(kids, 0), budget
        while open_:
            rest = sum(w[p] for p in open_)
            full = [p for p in open_ if Fraction(cap[p]) <= Fraction(left * w[p], rest)]
            if not full:
                for p in open_:
                    got[p] = left * w[p] // rest
                for p in open_[: left - sum(got[p] for p in open_)]:
                    got[p] += 1
                break
            for p in full:
                got[p] = cap[p]
            left -= sum(cap[p] for p in full)
            open_ = [p for p in open_ if p not in full]
        for p in kids:
            if k == 2:
                out[p] = (size[p], got[p])
            else:
                divide(p, got[p], k + 1)

    held = sum(size.values())
    divide((), min(held if total is None else total, held * max_epochs), 0)
    return out


def brute(rows, total=None, max_epochs=2, weights=None, seed=7):
    picked = []
    for leaf, (size, budget) in budgets(rows, total, max_epochs, weights or {}).items():
        mine = [r for r in rows if r[1:4] == leaf]
        whole, rest = divmod(budget, size) if size else (1, 0)
        picked += [(r[0], e) for r in mine for e in range(whole)]
        upto = 0
        for key, r in sorted((hashlib.md5(":".join([str(seed), str(whole)] + ([str(r[0])] if r[0] is not None else [])).encode()).hexdigest(), r) for r in mine):
            upto += r[4] or 0
            if rest and upto <= rest:
                picked.append((r[0], whole))
    return sorted(picked, key=str)


def test_mix_equals_brute_force(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    for total, most, weights in [(None, 2, None), (5000, 1, {"lang": {"en": 5, "fr": 2}}), (10**9, 3, None), (777, 2, {"domain": {"d0": 0}, "source": {"hot": 3}}), (0, 2, None)]:
        got = mix(docs, LEVELS, "n_tokens", budget=total, max_epochs=most, weights=weights)
        assert got.columns == [*docs.columns, "__mix_epoch"]
        assert sorted(((r.doc_id, r["__mix_epoch"]) for r in got.collect()), key=str) == brute(rows, total, most, weights)


def test_budget_is_spent_and_capped(spark):
    rows = documents()
    held = sum(r[4] or 0 for r in rows)
    got = leaf_budgets(spark.createDataFrame(rows, SCHEMA), LEVELS, "n_tokens", budget=held, max_epochs=2).collect()
    assert sum(r.budget for r in got) == held and all(r.budget <= 2 * r.leaf_tokens for r in got)


def test_siblings_share_a_shortage_before_the_parent(spark):
    nodes = [("p", "a", 1, 10), ("p", "b", 1, 100), ("p", "c", 2, 100), ("q", "z", 1, 5)]
    frame = spark.createDataFrame([(*n, 90 if n[0] == "p" else 5) for n in nodes], "parent string, node string, weight long, capacity long, parent_budget long")
    assert dict((r.node, r.budget) for r in shares(frame).collect()) == {"a": 10, "b": 27, "c": 53, "z": 5}


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mix(docs, LEVELS, "n_tokens").count() == 0
    assert mix(docs.withColumn("n_tokens", F.lit(None).cast("long")), LEVELS, "n_tokens").count() == 0
