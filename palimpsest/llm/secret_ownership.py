"""Secret scans with corpus-wide ownership (operator 12).

Base patterns find secrets in each text. Beside them the scan offers open
candidates: long tokens of mixed characters, and tokens in formats that
providers issue. Hashes of all candidate values are aggregated over the corpus
by distinct repositories and owners. A value that more than ``most_owners``
owners or ``most_repositories`` repositories hold is a copied example; any other
that looks live (varied characters, no placeholder words) belongs to its owners.
Open candidates are added where their value is live and either some text holds
it as a base secret (kind ``value``) or a provider's format (kind ``format``).
Base spans always stay; ``n_live`` and ``n_example`` say what the corpus thinks
of a document's reported spans.

Values never leave a worker: only 128-bit hashes are shuffled. Counts fold by
(value, owner, repository) before they move; values holding more than a
thousandth of all candidates, so at most a thousand, meet their verdict by
broadcast and all others by a shuffle join, so no value makes a hot task.

Defined cases: null and empty texts have no spans; null owners are one owner,
null repositories one repository of their owner; repeated rows are reported
alike; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.session import materialized

KINDS = ("assign", "access", "hex")
ADDED = ("value", "format")
MOST_OWNERS, MOST_REPOSITORIES = 3, 6
#: Values beyond this share of all candidates are joined by broadcast; so there are at most as many.
HOT_VALUES = 1000

# The base patterns.
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: Open candidates: bare tokens, and formats of well-known providers' keys.
_BARE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])")
_FORMAT = re.compile(r"(?<![A-Za-z0-9])(?:gh[opsu]_[A-Za-z0-9]{36}|[rs]k_live_[A-Za-z0-9]{24,}|xox[abp]-[0-9A-Za-z-]{20,}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})(?![A-Za-z0-9])")
_PLACEHOLDER = re.compile(r"(?i)example|sample|changeme|placeholder|dummy|your|xxxx|0{6}|1234567")

CANDIDATE = "array<struct<kind:int,start:int,end:int,value:string,live:boolean>>"
FOUND = f"doc_id long, owner string, repository string, n_assign long, n_access long, n_hex long, base_sha256 string, candidates {CANDIDATE}"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind number, start, end, value) of the base secrets, by start and kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(0, *m.span(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(1, *m.span(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(2, *m.span(), m[0]) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], s[0]))


def looks_live(value: str) -> bool:
    """Whether a value has the variety of an issued credential: 3 bits a character, digits and letters, no placeholder."""
    if len(value) < 8 or _PLACEHOLDER.search(value):
        return False
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())
    return entropy >= min(3.0, 0.8 * math.log2(len(value))) and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def open_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """(kind number beyond the base kinds, start, end, value) of live-looking tokens that touch no base span."""
    found = [(len(KINDS) + 1, *m.span(), m[0]) for m in _FORMAT.finditer(text)] if "_" in text or "-" in text or "." in text else []
    found += [(len(KINDS), *m.span(), m[0]) for m in _BARE.finditer(text)]
    out, end, k, taken = [], 0, 0, sorted((s[1], s[2]) for s in base)
    reach = 0
    for kind, lo, hi, value in sorted(found, key=lambda s: (s[1], -s[0])):
        while k < len(taken) and taken[k][0] < hi:
            reach, k = max(reach, taken[k][1]), k + 1
        if lo >= end and lo >= reach and looks_live(value):
            out.append((kind, lo, hi, value))
            end = hi
    return out


def spans_text(spans: list[tuple]) -> str:
    return ",".join(f"{(*KINDS, *ADDED)[k]}:{lo}:{hi}" for k, lo, hi, *_ in sorted(spans, key=lambda s: (s[1], s[0])))


def scan(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): base counts and hash, and all candidates with hashed values."""
    kinds = (*[pa.int64()] * 3, pa.string(), pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("live", pa.bool_())])))
    names = [*[f"n_{k}" for k in KINDS], "base_sha256", "candidates"]

    def search(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                value = text.as_py() or ""
                base = base_spans(value)
                held = Counter(s[0] for s in base)
                spans = [{"kind": k, "start": lo, "end": hi, "value": hashlib.blake2b(v.encode(), digest_size=16).hexdigest(), "live": looks_live(v)} for k, lo, hi, v in base + open_spans(value, base)]
                rows.append((*[held[k] for k in range(3)], hashlib.sha256(spans_text(base).encode()).hexdigest(), spans))
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("doc_id", "owner", "repository")] + [pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "owner", "repository", *names])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), owner.cast("string").alias("owner"), repository.cast("string").alias("repository"))
    return given.mapInArrow(search, FOUND)


def ownership(candidates: DataFrame, most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """(value, owners, repositories, n, secret, verdict) of each candidate value.

    ``candidates``: (value, owner, repository, kind, live). ``verdict`` is
    ``example`` for widely copied values, ``live`` for live-looking ones of few
    owners, else ``unlikely``.
    """
    folded = candidates.groupBy("value", "owner", "repository").agg(F.count("*").alias("n"), F.max(F.col("kind") < len(KINDS)).alias("secret"), F.max("live").alias("live"))
    folded = folded.groupBy("value", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"), F.max("secret").alias("secret"), F.max("live").alias("live"))
    totals = folded.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("n"), F.max("secret").alias("secret"), F.max("live").alias("live"))
    copied = (F.col("owners") > most_owners) | (F.col("repositories") > most_repositories)
    return totals.select("value", "owners", "repositories", "n", "secret", F.when(copied, "example").when(F.col("live"), "live").otherwise("unlikely").alias("verdict"))


def find(docs: DataFrame, owner: Column, repository: Column, most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """One row per document: base counts, the hash of the base spans, all reported spans, and how many are live or examples."""
    found = materialized(scan(docs, owner, repository).withColumn("row", F.monotonically_increasing_id()), "candidates")
    held = found.where(F.size("candidates") > 0)
    each = held.select("row", "owner", "repository", F.inline("candidates"))
    verdicts = materialized(ownership(each, most_owners, most_repositories), "verdicts")
    total = verdicts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    common = F.col("n") > total / HOT_VALUES
    hot = verdicts.where(common).select("value", F.col("secret").alias("hot_secret"), F.col("verdict").alias("hot_verdict"))
    rare = verdicts.where(~common).select("value", "secret", "verdict")
    marked = each.select("row", "kind", "start", "end", "value").join(F.broadcast(hot), "value", "left")
    names = ["row", "kind", "start", "end"]
    judged = marked.where("hot_verdict IS NOT NULL").select(*names, F.col("hot_secret").alias("secret"), F.col("hot_verdict").alias("verdict")).unionByName(
        marked.where("hot_verdict IS NULL").join(rare, "value").select(*names, "secret", "verdict"))
    added = (F.col("verdict") == "live") & ((F.col("kind") > len(KINDS)) | F.col("secret"))
    reported = judged.where((F.col("kind") < len(KINDS)) | added)
    label = F.element_at(F.array(*[F.lit(k) for k in (*KINDS, *ADDED)]), F.col("kind") + 1)
    per_row = reported.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", F.concat_ws(":", label, "start", "end").alias("span")))).alias("all"),
        F.count_if(F.col("verdict") == "live").alias("n_live"), F.count_if(F.col("verdict") == "example").alias("n_example"))
    digest = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256"]
    spans = F.array_join(F.transform(F.coalesce("all", F.array().cast("array<struct<start:int,kind:int,span:string>>")), lambda s: s["span"]), ",").alias("spans")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    none = found.where(F.size("candidates") == 0).select(*digest, F.lit("").alias("spans"), *[F.lit(0).cast("long").alias(c) for c in ("n_live", "n_example")])
    return held.join(per_row, "row", "left").select(*digest, spans, count("n_live"), count("n_example")).unionByName(none)
