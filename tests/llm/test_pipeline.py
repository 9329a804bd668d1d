"""The whole pipeline against the brute-force versions of its stages."""

import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from palimpsest.llm import likelihood_rules
from palimpsest.llm.skip_chain import base_spans

from . import test_join, test_mixing, test_rules
from .helpers import SCHEMA, corpus


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    sf_dir = str(tmp_path_factory.mktemp("sf"))
    rows = [r for r in corpus(6, 40) if r[0] != 7] + [(3000 + r[0], *r[1:]) for r in test_join.near_copies(4, 4, 12)]
    rows = [(*r[:1], f"{r[1]} write to me{r[0]}@mail.example.org or call +1 (437) 555-06{r[0] % 100:02}", *r[2:]) if r[1] and len(r[1]) > 300 and r[0] % 4 == 0 else r for r in rows]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{sf_dir}/documents.parquet")
    labels = [(r[0], int(r[0] % 5 > 0), 0) for r in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    return sf_dir, rows, labels


def key(row):
    return str(tuple(row))


def test_stages(spark, folder):
    sf_dir, rows, labels = folder
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "n-gram Jaccard join", "personal data", "source mixture", "best-fit packing"]

    def step(name, held):
        frame = spark.createDataFrame(held, SCHEMA)
        out = stages[name](spark, frame, sf_dir)
        return out, [tuple(r) for r in out.collect()]

    out, first = step("quality rules", rows)
    trusted = {i for i, q, _ in labels if q}
    verdicts = {(v[0], v[1:6]): v[-1] for v in test_rules.brute(rows, trusted, likelihood_rules.BUCKETS, likelihood_rules.THRESHOLD)}
    assert out.columns == docs.columns
    assert sorted(map(key, first)) == sorted(key(r) for r in rows if verdicts[r[0], test_rules.base(r[1])])

    out, second = step("n-gram Jaccard join", first)
    assert out.columns == docs.columns and set(second) <= set(first)
    assert sorted(r[0] for r in second) == sorted({c for _, n, c in test_join.brute(first, 80, 5) if n})

    out, third = step("personal data", second)
    assert out.columns == docs.columns and sorted(r[0] for r in third) == sorted(r[0] for r in second)
    before = {r[0]: r for r in second}
    for r in third:
        assert base_spans(r[1]) == [] and r[4] == len(r[1])
        if not base_spans(before[r[0]][1]):
            assert r[1] == before[r[0]][1]
    assert any("<EMAIL>" in r[1] for r in third) and any("<PHONE>" in r[1] for r in third)

    out, fourth = step("source mixture", third)
    assert out.columns == docs.columns
    domain = lambda s: None if s is None else f"domain{zlib.crc32(s.encode()) % 4}"
    leaves = [(r[0], domain(r[3]), r[2], r[3], len(re.findall(r"[^\x20\x09-\x0D]+", r[1])), 0) for r in third]
    assert sorted(r[0] for r in fourth) == sorted(i for i, _ in test_mixing.brute(leaves))

    out, fifth = step("best-fit packing", fourth)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in fourth:
        ids = np.array(library.encode(r[1], add_special_tokens=False).ids + [0], "<u4")
        want.update((r[0], k, zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048)))
    assert Counter((r[0], r[1], r[4]) for r in fifth) == want


def test_run_is_the_stages_in_order(spark, folder):
    sf_dir, *_ = folder
    got = corpus_pipeline.run(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), stage(spark, docs, sf_dir).schema)
    pieces = lambda d: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in d.collect())
    assert pieces(got) == pieces(docs)
