"""Phrase collocations by best-first branch and bound (operator 13).

Phrases grow word by word from their prefixes, language by language. A phrase of
count ``a`` scores ``2000000 * a / (l + r)`` at its worst cut into parts of
counts ``l`` and ``r``. No part is rarer than the whole, so with ``a`` the count
of a prefix and ``l`` the counts of the prefix's own prefixes the same formula
with ``r = a`` bounds the prefix and all that grows from it. A threshold per
language, at first the score of a pair well beyond the last place asked for,
cuts the frontier: prefixes whose bound reaches it are expanded, and both
neighbours of every phrase in contention are counted, as only they can make it
drop. Once enough undropped phrases reach the threshold, all of them are known
and the places are settled, ties included; otherwise the threshold of that
language falls, at last to nothing.

Each scan reads whole texts and adds up inside its task. Which prefixes are
expanded reaches the scans as one bit filter of ``BITS`` bits, whatever the
input; what it lets through beyond the frontier is counted exactly too and does
no harm. Counts meet phrases by shuffle joins on (language, phrase).

Defined cases: a null language is ``und``; null and empty texts have no words;
repeated rows count once each; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.cover_dedup import _hashes, _prefix
from palimpsest.session import materialized

LONGEST = 4
#: The bit filter: 8 MB, two bits a phrase.
BITS = 1 << 26
_FIELDS = (BITS - 5, BITS - 27)
#: Different words a task numbers before it starts afresh, so that with a stretch more they stay below 2^21; distinct phrases it holds; and bytes it cuts at a time.
MOST_NUMBERS, MOST_PHRASES, CHUNK = 1_000_000, 1_000_000, 1 << 20
#: The first threshold lies this many times the places asked for down the pairs; each further one this many times deeper.
DEPTH = 4
_WORD = (1 << 21) - 1

# A-Z become a-z, the ends of pieces a full stop, the tab a blank.
_FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else 0x2E if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b) for b in range(256))


class _Words:
    """Numbers the different words a task has met, from 1; 0 ends a piece.

    Words are looked up by a 64-bit hash, all of a stretch at once, and then
    compared byte by byte with the word that has the number, so a hash that two
    words share does not join them.
    """

    def __init__(self):
        self.table: dict[int, int] = {}
        self.others: dict[bytes, int] = {}
        self.spelled, self.checksums = [b"."], array("q", [0])
        self.letters, self.starts = bytearray(b"."), array("q", [0, 1])

    def __len__(self) -> int:
        return len(self.spelled)

    def _new(self, word: bytes) -> int:
        self.spelled.append(word)
        self.checksums.append(zlib.crc32(word))
        self.letters += word
        self.starts.append(len(self.letters))
        return len(self.spelled) - 1

    def numbers(self, text: bytes) -> np.ndarray:
        """The word numbers of a folded text, with a 0 between words of different pieces."""
        raw = np.frombuffer(text, np.uint8)
        ends_piece = raw == 0x2E
        turns = np.flatnonzero(np.diff(np.concatenate([[False], ~(ends_piece | (raw == 0x20)), [False]]).view(np.int8)))
        lo, hi = turns[::2], turns[1::2]
        if not len(lo):
            return np.zeros(0, np.int64)
        hashes, first, inverse = np.unique(_hashes(_prefix(raw), lo, hi).view(np.int64), return_index=True, return_inverse=True)
        codes = [self.table.get(h) for h in hashes.tolist()]
        for k, code in enumerate(codes):
            if code is None:
                codes[k] = self.table[int(hashes[k])] = self._new(text[lo[first[k]] : hi[first[k]]])
        codes = np.array(codes, np.int64)[inverse]
        for k in self._unlike(raw, lo, hi, codes).tolist():
            word = text[lo[k] : hi[k]]
            if word not in self.others:
                self.others[word] = self._new(word)
            codes[k] = self.others[word]
        piece = np.cumsum(ends_piece)[lo]
        apart = np.concatenate([[0], np.cumsum(piece[1:] != piece[:-1])])
        out = np.zeros(len(codes) + apart[-1], np.int64)
        out[np.arange(len(codes)) + apart] = codes
        return out

    def _unlike(self, raw: np.ndarray, lo: np.ndarray, hi: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Places of words that are not spelled like the word of their number."""
        starts = np.frombuffer(self.starts, np.int64)
        size, there = hi - lo, starts[codes]
        alike = starts[codes + 1] - there == size
        lengths = np.where(alike, size, 0)
        upto = np.cumsum(lengths)
        step = np.arange(upto[-1])
        mine = raw[np.repeat(lo - upto + lengths, lengths) + step]
        theirs = np.frombuffer(self.letters, np.uint8)[np.repeat(there - upto + lengths, lengths) + step]
        differs = np.concatenate([[0], np.cumsum(mine != theirs)])
        return np.flatnonzero(~alike | (differs[upto] > differs[upto - lengths]))


def _stretches(text: bytes, length: int):
    """A folded text in stretches that end between words; each starts with the ``length`` - 1 words before it, so every phrase lies in one and in no two."""
    start = carried = 0
    while start < len(text):
        end = len(text)
        if end - start > 2 * CHUNK:
            cut = max(text.rfind(b" ", start, start + CHUNK), text.rfind(b".", start, start + CHUNK))
            end = cut + 1 if cut > start else next((k + 1 for k in sorted((text.find(b" ", start + CHUNK), text.find(b".", start + CHUNK))) if k >= 0), len(text))
        yield text[carried:end]
        start = carried = end
        for _ in range(length - 1):
            while carried and text[carried - 1] in b" .":
                carried -= 1
            carried = max(text.rfind(b" ", 0, carried), text.rfind(b".", 0, carried)) + 1


def _fold(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal ``keys``, or equal rows of two columns of them, added up."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys) if keys.ndim == 1 else np.lexsort((keys[:, 1], keys[:, 0]))
    keys = keys[order]
    new = keys[1:] != keys[:-1]
    first = np.flatnonzero(np.concatenate([[True], new if keys.ndim == 1 else new.any(axis=1)]))
    return keys[first], np.add.reduceat(counts[order], first, dtype=counts.dtype)


class _Filter:
    """Membership of hashed phrases, by purpose: f frequent, e expanded, m missing."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.frequent: dict[str, np.ndarray] = {}

    def words(self, lang: str, checksums: np.ndarray) -> np.ndarray:
        """Which of a task's numbered words are frequent in ``lang``; words seen before are not asked again."""
        known = self.frequent.get(lang, np.zeros(1, bool))
        if len(known) < len(checksums):
            more = self.holds(_grown(zlib.crc32(f"f:{lang}".encode()), checksums[len(known) :]))
            known = self.frequent[lang] = np.concatenate([known, more])
        return known

    def holds(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for field in _FIELDS:
            place = h % field
            found &= (self.bits[place >> 6] >> (place & 63) & 1).astype(bool)
        return found


def _grown(h: np.ndarray | int, more: np.ndarray) -> np.ndarray:
    return h % 4_294_967_296 * 31 + more


def _keys(codes: np.ndarray, checksums: np.ndarray, lang: str, length: int, missing: bool, kept: _Filter | None) -> np.ndarray:
    """Keys of the occurrences of phrases of ``length`` words that a scan counts: 21 bits a word, the first of four words in a column of its own."""
    if length == 1:
        return codes[codes > 0]
    seed = {tag: zlib.crc32(f"{tag}:{lang}".encode()) for tag in "fem"}
    ok = kept.words(lang, checksums)[codes]
    at = np.flatnonzero(ok[:-1] & ok[1:])  # pairs of frequent words
    words = checksums[codes]
    pair = lambda tag, i: _grown(_grown(seed[tag], words[i]), words[i + 1])
    if length > 2:
        at = at[kept.holds(pair("f", at))]
        runs = at[:-1][at[1:] == at[:-1] + 1]  # two frequent pairs in a row
        triple = lambda tag, i: _grown(pair(tag, i), words[i + 2])
        if length == 3 and missing:
            at = runs[kept.holds(triple("m", runs))]
        else:
            grows = np.zeros(len(codes) + 1, bool)
            if length == 3:
                grows[at] = kept.holds(pair("e", at))
            else:
                grows[runs] = kept.holds(triple("e", runs))
                runs = runs[:-1][runs[1:] == runs[:-1] + 1]
            at = runs[grows[runs] | grows[runs + 1]]
    low = codes[at + length - 1]
    for k in range(max(0, length - 3), length - 1):
        low = low | codes[at + k] << 21 * (length - 1 - k)
    return np.stack([codes[at], low], 1) if length == 4 else low


def phrase_counts(docs: DataFrame, length: int, least: int, kept=None, missing: bool = False) -> DataFrame:
    """(lang, phrase, f) of the phrases of ``length`` words in ``docs`` (lang, text) that occur ``least`` times and that the broadcast filter ``kept`` lets through.

    Of single words, a row with the empty phrase has the number of all words.
    """

    def count(batches):
        words, held = _Words(), {}
        kept_here = _Filter(kept.value) if kept is not None else None

        def rows():
            for lang, parts in held.items():
                keys, counts = _fold(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                for lo in range(0, len(keys), 50_000):
                    part = keys[lo : lo + 50_000]
                    first, low = ([part[:, 0]], part[:, 1]) if length == 4 else ([], part)
                    numbers = first + [low >> 21 * k & _WORD for k in range(min(length, 3) - 1, -1, -1)]
                    spelled = [list(map(words.spelled.__getitem__, n.tolist())) for n in numbers]
                    phrases = list(map(b" ".join, zip(*spelled)))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts[lo : lo + 50_000], pa.int64())], names=["lang", "phrase", "n"])
                if length == 1:
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([""]), pa.array([int(counts.sum())])], names=["lang", "phrase", "n"])
            held.clear()

        def add(lang, texts):
            nonlocal words
            for part in _stretches(b".".join(texts).translate(_FOLD), length):
                if len(words) > MOST_NUMBERS:
                    yield from rows()
                    words = _Words()
                    if kept_here:
                        kept_here.frequent.clear()
                codes = words.numbers(part)
                keys = _keys(codes, np.array(words.checksums, np.int64), lang, length, missing, kept_here)
                if len(keys):
                    held.setdefault(lang, []).append(_fold(keys, np.ones(len(keys), np.int64)))

        def flushed():
            for lang, texts in waiting.items():
                yield from add(lang, texts)
            waiting.clear()
            if sum(len(p[0]) for parts in held.values() for p in parts) > MOST_PHRASES:
                for lang, parts in held.items():
                    held[lang] = [_fold(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))]
                if sum(len(parts[0][0]) for parts in held.values()) > MOST_PHRASES // 2:
                    yield from rows()

        waiting: dict[str, list[bytes]] = {}
        weight = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                value = (text.as_py() or "").encode()
                waiting.setdefault(lang, []).append(value)
                weight += len(value) + 1
                if weight >= CHUNK:
                    yield from flushed()
                    weight = 0
        yield from flushed()
        yield from rows()

    given = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string"))
    counted = given.mapInArrow(count, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    return counted.where((F.col("f") >= least) | (F.col("phrase") == ""))


def phrase_filter(sets: list[tuple[str, DataFrame]]):
    """The broadcast bit filter over tagged ``sets`` of (lang, phrase)."""
    every = None
    for tag, phrases in sets:
        h = F.aggregate(F.split("phrase", " "), F.crc32(F.concat(F.lit(f"{tag}:"), F.col("lang")).cast("binary")), lambda h, w: h % 4_294_967_296 * 31 + F.crc32(w.cast("binary")))
        places = phrases.where("phrase <> ''").select(h.alias("h")).select(F.explode(F.array(*[F.col("h") % f for f in _FIELDS])).alias("p"))
        every = places if every is None else every.unionByName(places)
    words = every.groupBy(F.expr("p div 64").alias("i")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("w")).toArrow()
    bits = np.zeros(BITS // 64, np.int64)
    bits[words.column("i").to_numpy()] = words.column("w").to_numpy()
    return sets[0][1].sparkSession.sparkContext.broadcast(bits)


def _exact(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def scored(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """``phrases`` (lang, phrase, f) with their lowest cut (score, l, r), the bound of what grows from them, and whether all parts are known.

    An unknown right part counts as rare as it can be, which bounds the score
    from above. A phrase of which a left part is unknown grew from no expanded
    prefix, so its score is below the threshold, and it is left out.
    """
    w, k = F.split("phrase", " "), F.col("k")
    cuts = phrases.select("lang", "phrase", "f", F.explode(F.sequence(F.lit(1), F.size(w) - 1)).alias("k"))
    cuts = cuts.select("*", F.array_join(F.slice(w, F.lit(1), k), " ").alias("left"), F.array_join(F.slice(w, k + 1, F.size(w)), " ").alias("right"))
    parts = lambda side, out: counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(out))
    cuts = cuts.join(parts("left", "l"), ["lang", "left"], "left").join(parts("right", "r"), ["lang", "right"], "left")
    score = lambda r: F.expr(f"cast(f AS decimal(20,0)) * 2000000 div (cast(l AS decimal(20,0)) + cast({r} AS decimal(20,0)))")
    lowest = F.min(F.struct(score("coalesce(r, f)").alias("score"), "k", "l", "r"))
    return cuts.groupBy("lang", "phrase", "f").agg(lowest.alias("low"), F.min(score("f")).alias("bound"), F.bool_and(F.col("r").isNotNull()).alias("known"), F.bool_and(F.col("l").isNotNull()).alias("rooted")).where("rooted").select(
        "lang", "phrase", "f", "low.score", "low.l", "low.r", "bound", "known")


def leaders(phrases: DataFrame, places: int, order: list[Column]) -> DataFrame:
    """The first ``places`` of each language with their rank; salted heads first, so no task sees a language whole."""
    salted = phrases.withColumn("__salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    heads = salted.withColumn("__row", F.row_number().over(Window.partitionBy("lang", "__salt").orderBy(*order))).where(F.col("__row") <= places)
    return heads.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= places).drop("__salt", "__row")


def dropped(phrases: DataFrame, longer: DataFrame) -> DataFrame:
    """(lang, phrase) of ``phrases`` (lang, phrase, f) with a neighbour one word longer in ``longer`` that holds four fifths of them.

    Any still longer one implies one of these, as counts never grow with length.
    """
    w = F.split("phrase", " ")
    sides = F.array(F.array_join(F.slice(w, F.lit(1), F.size(w) - 1), " "), F.array_join(F.slice(w, F.lit(2), F.size(w) - 1), " "))
    around = longer.select("lang", F.explode(F.array_distinct(sides)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    return phrases.join(around, ["lang", "phrase"]).where(5 * _exact(F.col("most")) >= 4 * _exact(F.col("f"))).select("lang", "phrase")


def collocations(docs: DataFrame, places: int = 2000, least: int = 30) -> DataFrame:
    """The first ``places`` phrases of each language of ``docs`` (lang, text): lang, rank, phrase, a, l, r, n, score."""
    words = materialized(phrase_counts(docs, 1, least), "words")
    totals, words = words.where("phrase = ''").select("lang", F.col("f").alias("n")), words.where("phrase <> ''")
    kept = phrase_filter([("f", words)])
    pairs = materialized(phrase_counts(docs, 2, least, kept), "pairs")
    kept.unpersist()
    pairs_scored = materialized(scored(pairs, words), "pairs-scored")
    best, depth = [F.desc("score"), F.desc("f"), F.asc("phrase")], places * DEPTH
    open_langs = pairs.select("lang").distinct()
    done: list[DataFrame] = []
    while True:
        heads = leaders(pairs_scored.join(open_langs, "lang", "left_semi"), depth, [F.desc("score"), F.asc("phrase")])
        enough = heads.groupBy("lang").agg(F.max("rank").alias("rank"), F.min("score").alias("score"))
        floor = materialized(enough.select("lang", F.when(F.col("rank") >= depth, F.col("score")).otherwise(0).alias("floor")), "floors")
        survivors = materialized(_survivors(docs, least, words, pairs, pairs_scored, floor), "survivors")
        found = survivors.groupBy("lang").agg(F.count("*").alias("found"))
        judged = floor.join(found, "lang", "left").select("lang", ((F.col("floor") == 0) | (F.coalesce("found", F.lit(0)) >= places)).alias("settled"))
        judged = materialized(judged, "settled")
        done.append(survivors.join(judged.where("settled"), "lang", "left_semi"))
        open_langs, depth = judged.where("NOT settled").select("lang"), depth * DEPTH
        if open_langs.isEmpty():
            break
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    return leaders(every, places, best).join(totals, "lang").select("lang", "rank", "phrase", F.col("f").alias("a"), "l", "r", "n", F.col("score").cast("long").alias("score"))


def _survivors(docs: DataFrame, least: int, words: DataFrame, pairs: DataFrame, pairs_scored: DataFrame, floor: DataFrame) -> DataFrame:
    """All undropped phrases (lang, phrase, f, score, l, r) that reach the ``floor`` (lang, floor) of their language."""
    reach = lambda phrases: phrases.join(floor, "lang")
    active = pairs.join(floor, "lang", "left_semi")
    frequent = words.join(floor, "lang", "left_semi")
    grown2 = reach(pairs_scored).where("bound >= floor").select("lang", "phrase")
    kept = phrase_filter([("f", frequent), ("f", active), ("e", grown2)])
    triples = materialized(phrase_counts(docs, 3, least, kept), "triples")
    kept.unpersist()
    triples_scored = materialized(scored(triples, words.unionByName(pairs)), "triples-scored")
    grown3 = reach(triples_scored).where("bound >= floor").select("lang", "phrase")
    kept = phrase_filter([("f", frequent), ("f", active), ("e", grown3)])
    fours = materialized(phrase_counts(docs, 4, least, kept), "fours")
    kept.unpersist()
    counts = words.unionByName(pairs).unionByName(triples)
    rough = reach(materialized(scored(fours, counts), "fours-rough")).where("score >= floor").drop("floor")
    tail = F.array_join(F.slice(F.split("phrase", " "), 2, 3), " ")
    unknown = materialized(rough.where("NOT known").select("lang", tail.alias("phrase")).distinct(), "missing")
    if not unknown.isEmpty():
        kept = phrase_filter([("f", frequent), ("f", active), ("m", unknown)])
        extra = materialized(phrase_counts(docs, 3, least, kept, missing=True), "extra")
        kept.unpersist()
        counts = counts.unionByName(extra.join(unknown, ["lang", "phrase"], "left_semi"))
        rough = rough.where("known").unionByName(scored(rough.where("NOT known").select("lang", "phrase", "f"), counts))
    names = ["lang", "phrase", "f", "score", "l", "r"]
    settled = reach(rough).where("score >= floor").select(*names)
    for shorter, longer in ((pairs_scored, triples), (triples_scored, fours)):
        inside = reach(shorter).where("score >= floor").select(*names)
        settled = settled.unionByName(inside.join(dropped(inside, longer), ["lang", "phrase"], "left_anti"))
    return settled
