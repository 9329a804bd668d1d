"""Jaccard join of word shingles by PartEnum signatures (operator 5).

A document's set is its distinct shingles. Sizes fall into bands so narrow that
two linked sets lie in one band or in neighbours; every pair of neighbouring
bands has its own signature scheme. There, linked sets differ in at most k
elements. The element domain is hashed into more than k + 1 parts, so at least
``slack`` + 1 parts of two linked sets agree. A set enumerates its parts, one
signature of all elements in a part each; it may leave out its smallest parts as
long as these are at most ``slack``, which spares empty and tiny ones (the larger
of two sets' limits leaves an agreeing part that both keep).

Equal sets are one class. Classes sharing a signature are candidates, yet their
pairs are never listed whole. Each signature's group has a root, the class that
shares most with others; all members are compared exactly with it (linear in the
group), and linked ones become components. Classes of groups that still hold
several components are regrouped by a prefix filter: linked sets share an element
among the rarest of each, so those few elements are the keys of finer groups.
In every round a finer group's members are dealt over ``ROOTS`` ** round salts,
each salt names one root, roots meet the members of other components and leave the
group, and groups within one component are settled. The number of roots grows
until no group is mixed, so about log(largest group) rounds are needed and pairs
that the components already decide are not listed.

Sets are compared as 64-bit hashes of shingles.

Defined cases: texts without words (null, empty, white space) have the empty set,
linked with nothing; texts of fewer words than a shingle have their whole word
sequence as the one element; repeated rows are one class; a null doc_id never
names a component that has another id; an empty table gives no rows; extra
columns are ignored. Only A-Z are lower-cased.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.cover_dedup import _hashes, _mix, _prefix
from palimpsest.session import materialized

#: Similarity of a link in hundredths.
PERCENT = 85
SHINGLE = 4
#: Parts of a scheme for each element that linked sets may differ in, beyond the first.
SPREAD = 1.8
SLICE = 1 << 19
#: A finer group has so many times more roots in each round.
ROOTS = 16
#: One of so many classes is looked at for frequent signatures; at most so many are named.
LOOK, MOST_FREQUENT = 64, 1000

_FACTORS = np.random.default_rng(4).integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end]) < SLICE):
            held += len(texts[end]) + 1
            end += 1
        out += _sets(texts[at:end], size)
        at = end
    return out


def _sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    raw = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    inside = np.concatenate([[False], ~((raw == 32) | ((raw >= 9) & (raw <= 13)))])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = turns[::2], turns[1::2]
    words = _hashes(_prefix(raw), starts, ends)
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]))
    n = len(words)
    whole = np.zeros(max(n - size + 1, 0), np.uint64)
    for k in range(size if n >= size else 0):
        whole += words[k : n - size + 1 + k] * _FACTORS[k]
    whole = _mix(whole)
    out = []
    for lo, hi in zip(bounds.tolist(), bounds[1:].tolist()):
        if hi - lo >= size:
            out.append(np.unique(whole[lo : hi - size + 1]))
        elif hi > lo:
            out.append(_mix(np.array([(words[lo:hi] * _FACTORS[8 : 8 + hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_id(elements: np.ndarray) -> int:
    """A set's name: a hash of all its elements and their number."""
    return int(_mix(np.array([_mix(elements ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(elements))], np.uint64)).view(np.int64)[0])


class Bands:
    """Size bands and the scheme of each pair of neighbours."""

    def __init__(self, percent: int, spread: float):
        self.percent, self.spread, self.tops = percent, spread, [0]

    def band(self, n: int) -> int:
        while self.tops[-1] < n:
            low = self.tops[-1] + 1
            self.tops.append(low * 100 // self.percent)
        return int(np.searchsorted(self.tops, n))

    def scheme(self, band: int) -> tuple[int, int]:
        """(parts, slack) for sets of ``band`` and the next one."""
        most = (100 - self.percent) * self.tops[band] // self.percent
        if not most:
            return 1, 0
        parts = int(np.ceil(self.spread * (most + 1)))
        return parts, parts - most - 1


def signatures(elements: np.ndarray, bands: Bands) -> np.ndarray:
    """A set's signatures in the scheme of its band and in that of the band below."""
    band, out = bands.band(len(elements)), []
    for scheme in (band, band - 1):
        if not scheme:
            continue
        parts, slack = bands.scheme(scheme)
        name = np.uint64((scheme + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        part = ((_mix(elements ^ name) >> np.uint64(33)) * np.uint64(parts)) >> np.uint64(31)
        counts = np.bincount(part.astype(np.int64), minlength=parts)
        sums = np.zeros(parts, np.uint64)
        np.add.at(sums, part.astype(np.int64), _mix(elements + _FACTORS[1]))
        kept = np.flatnonzero(counts >= np.partition(counts, slack)[slack])
        out.append(_mix(sums[kept] ^ _mix(name + kept.astype(np.uint64))))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def classes(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, cls, n) of every row of ``docs`` (doc_id, raw); cls is null for the empty set."""

    def name(batches):
        for batch in batches:
            sets = shingle_sets(batch.column("raw").to_pylist(), size)
            names = pa.array([class_id(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), names, pa.array([len(s) for s in sets], pa.int64())], names=["doc_id", "cls", "n"])

    return docs.mapInArrow(name, "doc_id long, cls long, n long")


def signature_rows(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(sig, cls) rows; a task repeats no class that it has just seen."""

    def emit(batches):
        bands, seen = Bands(percent, SPREAD), set()
        for batch in batches:
            sigs, names = [], []
            for s in shingle_sets(batch.column("raw").to_pylist(), size):
                name = class_id(s) if len(s) else None
                if name is not None and name not in seen:
                    seen.add(name)
                    sigs.append(signatures(s, bands))
                    names.append(name)
            if len(seen) > 500_000:
                seen.clear()
            if sigs:
                owner = np.repeat(np.array(names, np.int64), [len(s) for s in sigs])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(owner)], names=["sig", "cls"])

    return docs.select("raw").mapInArrow(emit, "sig long, cls long")


def tested(pairs: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """The linked ones of ``pairs`` (root, cls), compared exactly."""
    left = sets.select(F.col("cls").alias("root"), F.col("raw").alias("root_raw"))
    joined = pairs.select("root", "cls").join(sets, "cls").join(left, "root").select("root", "cls", "raw", "root_raw")

    def compare(batches):
        last, other = None, np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            mine = shingle_sets(batch.column("raw").to_pylist(), size)
            for root, cls, elements, raw in zip(batch.column("root").to_pylist(), batch.column("cls").to_pylist(), mine, batch.column("root_raw")):
                if root != last:
                    last, other = root, shingle_sets([raw.as_py()], size)[0]
                place = np.searchsorted(other, elements).clip(max=max(len(other) - 1, 0))
                shared = int((other[place] == elements).sum()) if len(other) else 0
                if 100 * shared >= percent * (len(elements) + len(other) - shared):
                    out.append((root, cls))
            columns = list(zip(*out)) if out else [()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["root", "cls"])

    return joined.mapInArrow(compare, "root long, cls long")


def components(links: DataFrame) -> DataFrame:
    """(cls, comp) of every class in ``links`` (root, cls); comp is the least class of a component.

    Labels take the least of their neighbours' and then their label's own label,
    so paths halve; every round is written to the shared folder.
    """
    both = materialized(links.select(F.col("root").alias("a"), F.col("cls").alias("b")).unionByName(links.select(F.col("cls").alias("a"), F.col("root").alias("b"))).distinct(), "links")
    labels = materialized(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "cls"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("cls", "b"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("comp").alias("near"))
        lower = labels.join(near, "cls").select("cls", F.col("comp").alias("old"), F.least("comp", "near").alias("step"))
        jump = labels.select(F.col("cls").alias("step"), F.col("comp").alias("far"))
        moved = materialized(lower.join(jump, "step", "left").select("cls", "old", F.least("step", F.coalesce("far", "step")).alias("comp")), "labels")
        labels = moved.select("cls", "comp")
        if moved.where("comp <> old").isEmpty():
            return labels


def _mixed(rows: DataFrame, key: str) -> DataFrame:
    """Rows of ``rows`` (key, comp, …) whose key has more than one component; counted before they are moved."""
    keys = rows.groupBy(key).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select(key)
    return rows.join(keys, key, "left_semi")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))


def signature_groups(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(key, cls) of every signature that more than one class has."""
    rows = signature_rows(docs, size, percent)
    few = signature_rows(docs.where(F.pmod(F.xxhash64("raw"), F.lit(LOOK)) == 0), size, percent).groupBy("sig").agg(F.count("*").alias("n"))
    frequent = materialized(few.where("n >= 8").orderBy(F.desc("n")).limit(MOST_FREQUENT).select("sig", F.lit(True).alias("frequent")), "frequent")
    salt = F.when(F.col("frequent"), F.pmod(F.col("cls"), F.lit(1024)).cast("int")).otherwise(-1)
    dealt = rows.join(F.broadcast(frequent), "sig", "left").select("sig", "cls", salt.alias("salt")).repartition("sig", "salt").dropDuplicates(["sig", "salt", "cls"])
    together = F.count("*").over(Window.partitionBy("sig", "salt"))
    kept = dealt.withColumn("together", together).where((F.col("together") > 1) | (F.col("salt") >= 0))
    return materialized(kept.select(F.col("sig").alias("key"), "cls"), "groups")


def star_pairs(groups: DataFrame) -> DataFrame:
    """Distinct (root, cls): every class of a group (key, cls) with the group's root, the class in most groups."""
    hubs = groups.groupBy("cls").agg(F.count("*").alias("hub"))
    roots = groups.join(hubs, "cls").groupBy("key").agg(F.max_by("cls", F.struct("hub", "cls")).alias("root"))
    return materialized(groups.join(roots, "key").where("root <> cls").select("root", "cls").distinct(), "pairs")


def elements(sets: DataFrame, size: int) -> DataFrame:
    """(cls, n, element) of every element of ``sets`` (cls, raw)."""

    def emit(batches):
        for batch in batches:
            found = shingle_sets(batch.column("raw").to_pylist(), size)
            counts = np.array([len(s) for s in found], np.int64)
            owner = np.repeat(batch.column("cls").to_numpy(zero_copy_only=False), counts)
            flat = np.concatenate([*found, np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(np.repeat(counts, counts)), pa.array(flat.view(np.int64))], names=["cls", "n", "element"])

    return sets.select("cls", "raw").mapInArrow(emit, "cls long, n long, element long")


def finer_groups(rows: DataFrame, percent: int) -> DataFrame:
    """(key, cls, n, rest) groups of classes of ``rows`` (cls, n, element) that share one of their rarest elements.

    A set has ``need`` elements or more in common with any set linked to it, so
    all but the last ``need`` - 1 of its elements, rarest first, suffice.
    Elements that no other class has come first and key nothing. ``rest`` counts
    the set's elements behind the key.
    """
    need = F.ceil(percent * F.col("n") / 100)
    often = rows.groupBy("element").agg(F.count("*").alias("often")).where("often > 1")
    own = Window.partitionBy("cls")
    ranked = rows.join(often, "element").select(
        "element", "cls", "n", F.row_number().over(own.orderBy("often", "element")).alias("place"), F.count("*").over(own).alias("n_common"))
    return ranked.where(F.col("place") <= F.col("n_common") - need + 1).select(F.col("element").alias("key"), "cls", "n", (F.col("n_common") - F.col("place")).alias("rest"))


def rooted(groups: DataFrame, roots: int) -> DataFrame:
    """``groups`` (key, cls, n, rest, comp) with is_root: of a group's members with one salt of ``roots``, the class in most groups is the root."""
    hubs = groups.groupBy("cls").agg(F.count("*").alias("hub"))
    salted = groups.join(hubs, "cls").withColumn("salt", F.pmod(F.xxhash64("cls", F.lit(roots)), F.lit(roots)))
    named = salted.groupBy("key", "salt").agg(F.max_by("cls", F.struct("hub", "cls")).alias("cls")).select("key", "cls", F.lit(True).alias("is_root"))
    return groups.join(named, ["key", "cls"], "left").withColumn("is_root", F.coalesce("is_root", F.lit(False)))


def cross_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Distinct (root, cls) of roots and members of one group of ``rooted`` that components, sizes and what follows the key leave open.

    All that two sets share lies at or behind their first shared key, so in its
    group the overlap that a link needs fits into one element and the shorter rest.
    """
    roots = members.where("is_root").select("key", F.col("cls").alias("root"), F.col("n").alias("root_n"), F.col("rest").alias("root_rest"), F.col("comp").alias("root_comp"))
    near = (percent * F.greatest("n", "root_n") <= 100 * F.least("n", "root_n")) & (F.col("comp") != F.col("root_comp"))
    enough = (100 + percent) * (F.least("rest", "root_rest") + 1) >= percent * (F.col("n") + F.col("root_n"))
    once = ~F.col("is_root") | (F.col("root") < F.col("cls"))
    return members.join(roots, "key").where(near & enough & once).select("root", "cls").distinct()


def links(docs: DataFrame, named: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(root, cls) links between classes, enough of them to join every component."""
    groups = signature_groups(docs, size, percent)
    heads = groups.select("cls").distinct()
    wanted = named.where("cls is not null").groupBy("cls").agg(F.min("kid").alias("kid")).join(heads, "cls", "left_semi")
    sets = materialized(docs.join(wanted, "kid").transform(lambda d: _same_class(d, size)).dropDuplicates(["cls"]), "sets")
    found = materialized(tested(star_pairs(groups), sets, size, percent), "links")
    labels = components(found)
    apart = _mixed(_labelled(groups, labels), "key").select("cls").distinct()
    rows = materialized(elements(sets.join(apart, "cls", "left_semi"), size), "elements")
    finer = _mixed(_labelled(finer_groups(rows, percent), labels), "key")
    roots = 1
    while True:
        members = materialized(rooted(materialized(finer, "finer"), roots), "members")
        if members.isEmpty():
            return found
        new = materialized(tested(materialized(cross_pairs(members, percent), "pairs"), sets, size, percent), "links")
        found = found.unionByName(new)
        labels = components(found)
        finer = _mixed(_labelled(members.where("not is_root").drop("is_root", "comp"), labels), "key")
        roots *= ROOTS


def _same_class(docs: DataFrame, size: int) -> DataFrame:
    """Rows of ``docs`` (raw, cls) whose text has the class they were joined with."""

    def keep(batches):
        for batch in batches:
            names = [class_id(s) if len(s) else None for s in shingle_sets(batch.column("raw").to_pylist(), size)]
            yield batch.filter(pa.array([a == b for a, b in zip(names, batch.column("cls").to_pylist())], pa.bool_()))

    return docs.select("cls", "raw").mapInArrow(keep, "cls long, raw binary")


def labelled_rows(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Rows with words as (doc_id, cls, n, comp), and the others as (doc_id, n)."""
    raw = F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw.alias("raw"))
    named = materialized(classes(base, size), "classes")
    keyed = base.select(F.coalesce("doc_id", F.lit(-1)).alias("kid"), "raw")
    found = links(keyed, named.withColumn("kid", F.coalesce("doc_id", F.lit(-1))), size, percent)
    labelled = _labelled(named.where("cls is not null"), components(found)).select("doc_id", "cls", "n", "comp")
    return materialized(labelled, "labelled"), named.where("cls is null").select("doc_id", "n")


def join_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text)."""
    labelled, empty = labelled_rows(docs, size, percent)
    heads = labelled.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    rows = labelled.join(heads, "comp").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return rows.unionByName(empty.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _free(docs: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def keep_first(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row per component: one of its smallest doc_id; all rows of empty sets stay.

    Rows without doc_id stand for a component only if it has no id at all. Extra
    columns stay, whatever their names.
    """
    kid, cls = _free(docs, "__kid"), _free(docs, "__cls")
    labelled, _ = labelled_rows(docs.select("doc_id", "text"), size, percent)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "cls")
    kept = labelled.groupBy("comp").agg(F.min_by(F.struct("doc_id", "cls"), order).alias("k")).select(F.coalesce("k.doc_id", F.lit(-1)).alias(kid), F.col("k.cls").alias(cls))
    text_at, class_at = docs.columns.index("text"), len(docs.columns)

    def keep(batches):
        for batch in batches:
            texts = [(t or "").encode(errors="replace") for t in batch.column(text_at).to_pylist()]
            names = [class_id(s) if len(s) else None for s in shingle_sets(texts, size)]
            yield batch.filter(pa.array([a == b for a, b in zip(names, batch.column(class_at).to_pylist())], pa.bool_()))

    keyed = docs.withColumn(kid, F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)))
    matched = keyed.join(kept, kid).select(*docs.columns, cls)
    once = matched.mapInArrow(keep, matched.schema).dropDuplicates([cls]).select(*docs.columns)
    empty = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return once.unionByName(docs.where(empty))
