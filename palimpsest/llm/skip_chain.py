"""Personal data by base patterns and a skip-chain conditional random field (operator 1).

The base patterns give observed entities. Every other mention that could be one
(a number of seven digits or more, or an address written loosely) is a node of a
field over the labels none, email, ip, card and phone, beside the observed ones.
Chain edges join neighbouring mentions; skip edges join mentions of the same key
(the same last seven digits, or the same address in lower case) however far
apart: each with the key's first observed entity, or with its next mention where
none is observed, so k repeats need k - 1 edges. Loopy sum-product message
passing gives each open mention a marginal; where a label beats "none" the
mention is added under that label. Base spans are clamped and always stay.

Potentials are counts: label by shape of the number, agreement of same-key
pairs and of neighbours among the observed entities of all documents, smoothed;
an open mention starts ``CAUTION`` nats below "none" because it failed its
pattern's own test. Of numbers side by side, those parted by blanks whose key is
observed are mentions by themselves; the rest of the run is read greedily.

Defined cases: null and empty texts have no spans; repeated rows are treated
alike; an empty table gives no rows; ``find`` ignores extra columns and
``redact`` carries them through.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)
CAUTION = 4.0
ROUNDS = 12

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The base patterns. A number's match always starts at its first digit, hence the look-behind.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Open mentions: numbers with any of the usual separators, and addresses with a spelled or spaced sign.
_NUMBER = re.compile(r"(?<![0-9])[0-9](?:[\x20().\-/]{0,2}[0-9]){6,30}(?![0-9])")
#: Numbers beside each other with a blank or two between them, and one of them.
_RUN = re.compile(r"(?<![0-9])[0-9](?:[\x20().\-/]{0,2}[0-9]){6,}")
_PART = re.compile(r"[0-9](?:[().\-/]{0,2}[0-9])*")
_LOOSE = re.compile(r"(?i)([a-z0-9._%+-]{1,64}+)(?:\x20?[\[(]at[\])]\x20?|\x20@\x20?|@\x20)([a-z0-9-]{1,63}+(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[a-z0-9-]{1,63}+){1,8})")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by the base patterns, by kind and start."""
    out = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            out.append((0, start, end))
        at = text.find("@", max(end, at + 1))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) < 3 or len(p) == 3 and p <= "255" for p in parts):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGITS.sub("", m[0])) <= 15:
            out.append((3, *m.span()))
    return out


def _key(kind: int, value: str) -> str:
    if kind == 0:
        plain = re.sub(r"\s*[\[(](at|dot)[\])]\s*", lambda m: "@" if m[1].lower() == "at" else ".", value, flags=re.I)
        return re.sub(r"\s*@\s*", "@", plain).lower()
    digits = _NOT_DIGITS.sub("", value)
    return digits if kind == 1 else digits[-7:]


def _shape(value: str, address: bool) -> str:
    if address:
        return "address"
    digits = len(_NOT_DIGITS.sub("", value))
    return f"{'7-8' if digits < 9 else '9-12' if digits < 13 else '13-19' if digits < 20 else '20+'}{'.' if value.count('.') > 2 else ''}"


def _repeats(text: str, lo: int, hi: int, observed: dict[str, set[str]]) -> list[tuple[int, int]]:
    """Spans of blank-delimited numbers in a run that have an observed key; of overlapping ones, the one most like an observed number."""
    parts = [m.span() for m in _PART.finditer(text, lo, hi)]
    found = []
    for i, (start, _) in enumerate(parts):
        for _, end in parts[i:]:
            digits = _NOT_DIGITS.sub("", text[start:end])
            if len(digits) > 31:
                break
            alike = [len(os.path.commonprefix([digits[::-1], o[::-1]])) for o in observed.get(f"n{digits[-7:]}", ())] if len(digits) > 6 else []
            if alike:
                found.append((-max(alike), len(digits), start, end))
    chosen: list[tuple[int, int]] = []
    for _, _, start, end in sorted(found):
        k = bisect.bisect(chosen, (start, end))
        if (not k or chosen[k - 1][1] <= start) and (k == len(chosen) or end <= chosen[k][0]):
            chosen.insert(k, (start, end))
    return chosen


def _numbers(text: str, base: list[tuple[int, int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of open numbers: repeats of observed ones by themselves, then greedy runs in what they and the base spans leave."""
    observed: dict[str, set[str]] = {}
    for kind, lo, hi in base:
        if kind:
            observed.setdefault(f"n{_key(kind, text[lo:hi])}", set()).add(_NOT_DIGITS.sub("", text[lo:hi]))
    found, k = [], 0
    for run in _RUN.finditer(text):
        at, stop = run.span()
        while k < len(taken) and taken[k][1] <= at:
            k += 1
        cuts, j = [], k
        while j < len(taken) and taken[j][0] < stop:
            cuts.append(taken[j])
            j += 1
        for lo, hi in zip([at, *(c[1] for c in cuts)], [*(c[0] for c in cuts), stop]):
            alone = _repeats(text, lo, hi, observed) if observed and lo < hi else []
            found += alone
            for start, end in zip([lo, *(c[1] for c in alone)], [*(c[0] for c in alone), hi]):
                found += [m.span() for m in _NUMBER.finditer(text, start, end)] if start < end else []
    return found


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, str]]:
    """Nodes by start: (label or -1 if open, start, end, key, shape). Open ones overlap no base span."""
    nodes = [(kind + 1, lo, hi, f"{'a' if not kind else 'n'}{_key(kind, text[lo:hi])}", _shape(text[lo:hi], not kind)) for kind, lo, hi in base]
    taken: list[tuple[int, int]] = []  # unions of overlapping base spans
    for lo, hi in sorted((lo, hi) for _, lo, hi in base):
        if taken and lo < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(hi, taken[-1][1]))
        else:
            taken.append((lo, hi))
    found = [(m.span(), True) for m in _LOOSE.finditer(text)] if "@" in text or "at]" in text.lower() or "at)" in text.lower() else []
    found = [(s, a) for s, a in found if not (k := bisect.bisect_left(taken, (s[1],))) or taken[k - 1][1] <= s[0]]
    found += [(span, False) for span in _numbers(text, base, taken)]
    for (lo, hi), address in found:
        value = text[lo:hi]
        nodes.append((-1, lo, hi, f"{'a' if address else 'n'}{_key(0 if address else 3, value)}", _shape(value, address)))
    return sorted(nodes, key=lambda n: (n[1], n[2], n[0]))


def _edges(nodes) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    chain = [(i, i + 1) for i in range(len(nodes) - 1)]
    alike: dict[str, list[int]] = {}
    for i, n in enumerate(nodes):
        alike.setdefault(n[3], []).append(i)
    skip = []
    for group in alike.values():
        seen = next((i for i in group if nodes[i][0] > 0), None)
        skip += zip(group, group[1:]) if seen is None else [(seen, i) for i in group if i != seen]
    return chain, skip


def document_counts(text: str) -> Counter:
    """What one document adds to the fit: label by shape, and agreement of observed pairs."""
    counts: Counter = Counter()
    nodes = mentions(text, base_spans(text))
    for label, *_, shape in nodes:
        counts["shape", shape, max(label, 0)] += 1
    for name, edges in zip(("chain", "skip"), _edges(nodes)):
        for i, j in edges:
            if nodes[i][0] > 0 and nodes[j][0] > 0:
                counts[name, "same" if nodes[i][0] == nodes[j][0] else "other", 0] += 1
    return counts


def potentials(counts: dict[tuple[str, str, int], int]) -> dict:
    """Log potentials from counts: unary by shape, and the bonus of agreement along chain and skip edges."""
    unary = {}
    for shape in {s for kind, s, _ in counts if kind == "shape"} | {""}:
        n = np.array([counts.get(("shape", shape, label), 0) + 1.0 for label in range(LABELS)])
        log = np.log(n / n.sum())
        log[1:] = np.minimum(log[1:] - log[0], 0) - CAUTION
        log[0] = 0
        unary[shape] = log
    bonus = {}
    for name, least, most in (("chain", 0.0, 0.5), ("skip", 6.0, 9.0)):
        same, other = counts.get((name, "same", 0), 0) + 1.0, counts.get((name, "other", 0), 0) + 1.0
        bonus[name] = min(most, max(least, math.log(same * (LABELS - 1) / other)))
    return {"unary": unary, "bonus": bonus}


def added_spans(text: str, base: list[tuple[int, int, int]], model: dict) -> list[tuple[int, int, int]]:
    """Open mentions whose marginal label is an entity, by loopy belief propagation."""
    nodes = mentions(text, base)
    open_ = [i for i, n in enumerate(nodes) if n[0] < 0]
    if not open_ or len(open_) == len(nodes):
        return []
    chain, skip = _edges(nodes)
    unary = np.full((len(nodes), LABELS), -1e9)  # observed labels are certain
    for i, n in enumerate(nodes):
        if n[0] > 0:
            unary[i, n[0]] = 0.0
        else:
            unary[i] = model["unary"].get(n[4], model["unary"][""])
            if n[3][0] == "a":
                unary[i, 2:] = -60.0
            else:
                unary[i, 1] = -60.0
    pair = np.stack([model["bonus"][name] * np.eye(LABELS) for name in ("chain", "skip")])
    edges = np.array(chain + skip, np.int64).reshape(-1, 2)
    kind = np.array([0] * len(chain) + [1] * len(skip))
    source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    kind, back = np.concatenate([kind, kind]), np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    message = np.zeros((len(source), LABELS))
    for _ in range(ROUNDS):
        belief = unary.copy()
        np.add.at(belief, target, message)
        out = (belief[source] - message[back])[:, :, None] + pair[kind]
        top = out.max(1)
        fresh = top + np.log(np.exp(out - top[:, None, :]).sum(1))
        fresh -= fresh.max(1, keepdims=True)
        if np.abs(fresh - message).max() < 1e-6:
            break
        message = 0.5 * message + 0.5 * fresh
    belief = unary.copy()
    np.add.at(belief, target, message)
    return [(int(np.argmax(belief[i])) - 1, nodes[i][1], nodes[i][2]) for i in open_ if belief[i].argmax() > 0]


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{lo}:{hi}" for k, lo, hi in sorted(spans))


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each union of overlapping spans replaced by the name of its first kind."""
    out, end = [], 0
    merged: list[list[int]] = []
    for lo, hi, k in sorted((lo, hi, k) for k, lo, hi in spans):
        if merged and lo < merged[-1][1]:
            merged[-1][1] = max(hi, merged[-1][1])
        else:
            merged.append([lo, hi, k])
    for lo, hi, k in merged:
        out += [text[end:lo], f"<{KINDS[k].upper()}>"]
        end = hi
    return "".join([*out, text[end:]])


def fit(docs: DataFrame) -> dict:
    """Potentials from the counts of all ``docs`` (text); a few dozen sums reach the driver."""

    def count(batches):
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                value = text.as_py() or ""
                if "@" in value or _DIGIT.search(value):
                    held.update(document_counts(value))
        if held:
            yield pa.RecordBatch.from_pylist([{"kind": k[0], "name": k[1], "label": k[2], "n": n} for k, n in held.items()], schema=pa.schema([("kind", pa.string()), ("name", pa.string()), ("label", pa.int32()), ("n", pa.int64())]))

    rows = docs.select(F.col("text").cast("string")).mapInArrow(count, "kind string, name string, label int, n long").groupBy("kind", "name", "label").agg(F.sum("n").alias("n")).collect()
    return potentials({(r.kind, r.name, r.label): r.n for r in rows})


def find(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """One row per document: base counts, the hash of the base spans, and all spans."""
    model = model or fit(docs)

    def search(batches):
        for batch in batches:
            base_counts, hashes, spans = [], [], []
            for text in batch.column("text"):
                value = text.as_py() or ""
                base = base_spans(value)
                added = added_spans(value, base, model) if base else []
                base_counts.append([sum(s[0] == k for s in base) for k in range(len(KINDS))])
                hashes.append(hashlib.sha256(spans_text(base).encode()).hexdigest())
                spans.append(spans_text(base + added))
            counts = np.array(base_counts, np.int64).reshape(-1, len(KINDS))
            columns = [batch.column("doc_id"), *[pa.array(counts[:, k]) for k in range(len(KINDS))], pa.array(hashes, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(search, schema)


def redact(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """``docs`` with every found span in ``text`` replaced by its kind; null stays null, other columns stay."""
    model = model or fit(docs)
    place = docs.columns.index("text")

    def mask(batches):
        for batch in batches:
            texts = []
            for text in batch.column(place):
                value = text.as_py()
                base = base_spans(value) if value else []
                texts.append(masked(value, base + added_spans(value, base, model)) if base else value)
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field(place).type) if k == place else batch.column(k) for k in range(batch.num_columns)], schema=batch.schema)

    return docs.mapInArrow(mask, docs.schema)
