import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palimpsest.llm import count_packing, length_histogram, matrix_packing
from palimpsest.llm.tokens import encoder

from .helpers import corpus, frame

CAPACITY = 64


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library(library):
    strange = ["\x1c a\x1fb \x85c\xa0d e", "ªº×÷ßẞŉſK", "a\x00b", "퟿ ﬁ ȩ́", "'s't're", "İI ıi", "   ", "\n", "１２３ ⅷ", "́ x"]
    for text in [r[1] or "" for r in corpus()] + strange:
        assert encoder("word_bpe_49k.json").encode(text).tolist() == ids_of(library, text), text[:50]


def test_plan_is_best_fit_over_counts():
    counts = {60: 3, 40: 2, 30: 7, 20: 4, 4: 9, 1: 50}
    plan = count_packing.plan_counts(counts, 64)
    slots = {}
    for length, first, n, sequence, offset in plan:
        for i in range(n):
            slots[length, first + i] = (sequence + i, offset)
    assert set(slots) == {(length, r) for length, n in counts.items() for r in range(n)}
    spans = sorted((s, o, o + length) for (length, _), (s, o) in slots.items())
    for (s, lo, hi), (t, lo2, _) in zip(spans, spans[1:]):
        assert lo2 == hi if s == t else lo2 == 0
    assert max(hi for _, _, hi in spans) <= 64
    lengths = [length for length, n in counts.items() for _ in range(n)]
    assert len({s for s, _, _ in spans}) == len(matrix_packing.best_fit(lengths, 64))


def test_packing_is_gapless_and_whole(spark, library):
    rows = corpus()
    got = count_packing.pack_documents(frame(spark, [(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, length int"), capacity=CAPACITY).collect()
    want = []
    for doc_id, text, *_ in rows:
        ids = np.array(ids_of(library, text) + [0], "<u4")
        want += [(doc_id, k, s, len(ids[s : s + CAPACITY]), zlib.crc32(ids[s : s + CAPACITY].tobytes())) for k, s in enumerate(range(0, len(ids), CAPACITY))]
    assert sorted(r[:5] for r in got) == sorted(want)
    spans = sorted((r.sequence_id, r.offset, r.offset + r.length) for r in got)
    for (s, _, hi), (t, lo2, _) in zip(spans, spans[1:]):
        assert lo2 == (hi if s == t else 0)
    assert max(hi for _, _, hi in spans) <= CAPACITY
    assert len({s for s, _, _ in spans}) == len(matrix_packing.best_fit([r.length for r in got], CAPACITY))


def test_matrices_round_trip(spark, library):
    rows = corpus()
    matrix = matrix_packing.id_matrices(frame(spark, rows), capacity=CAPACITY, block_tokens=5000, pad_id=7)
    for r in matrix.collect():
        assert len(r.input_ids) == 4 * CAPACITY and r.cu_seqlens[-1] == r.n_tokens <= CAPACITY and r.position_resets == r.cu_seqlens[:-1]
    docs = {}
    for r in matrix_packing.unpack(matrix).collect():
        docs.setdefault(r.doc_id, {}).setdefault(r.piece, []).append(np.frombuffer(r.ids, "<u4"))
    for doc_id, text, *_ in rows:
        copies = sum(x[0] == doc_id for x in rows)
        parts = docs[doc_id]
        assert all(len(p) == copies for p in parts.values())
        assert np.concatenate([parts[k][0] for k in sorted(parts)]).tolist() == ids_of(library, text) + [0]


def test_histogram_answers_every_limit(spark, library):
    rows = corpus()
    lengths = [len(ids_of(library, r[1])) for r in rows]
    for r in length_histogram.token_counts(frame(spark, rows)).collect():
        assert r.n_docs == lengths.count(r.length)
        assert r.docs_at_least == sum(x >= r.length for x in lengths)
        assert r.tokens_at_least == sum(x for x in lengths if x >= r.length)
        assert r.truncated_tokens == sum(min(x, r.length) for x in lengths)
        assert r["quantile"] == sum(x <= r.length for x in lengths) / len(lengths)


def test_limits_and_quantiles_between_and_beyond_the_lengths(spark, library):
    rows = corpus()
    lengths = sorted(len(ids_of(library, r[1])) for r in rows)
    totals = length_histogram.token_counts(frame(spark, rows))
    limits = [0, 1, 2048, 4096, 8192, 10**7, lengths[9], lengths[-1], lengths[-1] + 1, *{x + 1 for x in lengths}]
    got = {r.limit: tuple(r)[1:] for r in length_histogram.at_limits(totals, limits).collect()}
    assert got == {k: (sum(x >= k for x in lengths), sum(x for x in lengths if x >= k), sum(min(x, k) for x in lengths), sum(x <= k for x in lengths) / len(lengths)) for k in limits}
    shares = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = {r.share: r.length for r in length_histogram.at_quantiles(totals, shares).collect()}
    assert got == {q: next(x for i, x in enumerate(lengths) if sum(y <= x for y in lengths) / len(lengths) >= q) for q in shares}
    none = length_histogram.token_counts(frame(spark, []))
    assert [tuple(r) for r in length_histogram.at_limits(none, [2048]).collect()] == [(2048, 0, 0, 0, None)]
    assert [tuple(r) for r in length_histogram.at_quantiles(none, [0.5]).collect()] == [(0.5, None)]


def test_empty_tables(spark):
    none = frame(spark, [])
    assert count_packing.pack_documents(none).count() == 0
    assert matrix_packing.id_matrices(none).count() == 0
    assert length_histogram.token_counts(none).count() == 0
    assert count_packing.pack_documents(none).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert length_histogram.token_counts(none).agg(F.count("*")).first()[0] == 0
