"""Header scans of tensor files and decoding of their payloads.

A scan reads a file's header, never its weights. Files are listed once on the
driver, like any Spark file source, and packed into partitions; parsing and
decoding run inside the tasks. A file that cannot be read is a row with
``error``.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

# Element types and their byte sizes, header limits, and the
# quantised types' names.
BYTE_SIZES = {"F64": 8, "F32": 4, "F16": 2, "BF16": 2, "F8_E4M3": 1, "F8_E5M2": 1, "I64": 8, "I32": 4, "I16": 2, "I8": 1,
              "U64": 8, "U32": 4, "U16": 2, "U8": 1, "BOOL": 1}
MAX_HEADER = 100_000_000
MAX_COUNT = 1_000_000
PREVIEW = 8
GGML_TYPES = {0: "F32", 1: "F16", 2: "Q4_0", 3: "Q4_1", 6: "Q5_0", 7: "Q5_1", 8: "Q8_0", 9: "Q8_1",
              10: "Q2_K", 11: "Q3_K", 12: "Q4_K", 13: "Q5_K", 14: "Q6_K", 15: "Q8_K",
              16: "IQ2_XXS", 17: "IQ2_XS", 18: "IQ3_XXS", 19: "IQ1_S", 20: "IQ4_NL", 21: "IQ3_S",
              22: "IQ2_S", 23: "IQ4_XS", 24: "I8", 25: "I16", 26: "I32", 27: "I64", 28: "F64",
              29: "IQ1_M", 30: "BF16"}
SCALARS = {0: "<B", 1: "<b", 2: "<H", 3: "<h", 4: "<I", 5: "<i", 6: "<f", 7: "<?", 10: "<Q", 11: "<q", 12: "<d"}

SCHEMA = ("path string, file_size bigint, name string, dtype string, shape array<bigint>, byte_start bigint, byte_end bigint, "
          "metadata map<string,string>, version int, error string")
FILES_PER_TASK = 64
#: Bytes a header scan asks a file system for at a time, and a hash reads.
HEADER_BUFFER, HASH_BLOCK = 1 << 16, 8 << 20


def _located(path: str):
    """The file system of a path or URI, and the path there."""
    from pyarrow import fs

    # Hadoop spells local URIs with one slash
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def open_file(path: str):
    """A seekable file on any file system Arrow knows."""
    system, inner = _located(path)
    return system.open_input_file(inner)


def open_header(path: str):
    """A file read from its start through a buffer, so that many small values cost few reads."""
    system, inner = _located(path)
    return system.open_input_stream(inner, buffer_size=HEADER_BUFFER)


def write_files(rows: DataFrame, folder: str) -> int:
    """Writes each row (name, content) as one file below ``folder``, a URI that all executors share; the number of files."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                system, inner = _located(f"{folder}/{name}")
                system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(inner) as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return rows.select("name", F.col("content").cast("binary")).mapInArrow(write, "n bigint").agg(F.sum("n")).first()[0] or 0


def list_files(path: str, pattern: str) -> list[tuple[str, int]]:
    from pyarrow import fs

    scheme = path.split("://")[0] + "://" if "://" in path else ""
    system, inner = fs.FileSystem.from_uri(path if scheme else f"file://{path}")
    prefix = "" if scheme in ("", "file://") else scheme
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern))


def read_tensor_header(handle) -> tuple[dict[str, str], list[tuple]]:
    """metadata and (name, dtype, shape, start, end) in physical order."""
    raw = handle.read(8)
    if len(raw) < 8:
        raise ValueError("truncated: needs 8 bytes")
    n = struct.unpack("<Q", raw)[0]
    if n > MAX_HEADER:
        raise ValueError(f"header too large: {n}")
    text = handle.read(n)
    if len(text) < n:
        raise ValueError(f"truncated: needs {8 + n} bytes")
    top = json.loads(text)
    if not isinstance(top, dict):
        raise ValueError("top level is not an object")
    meta = top.pop("__metadata__", {})
    metadata = {k: v if isinstance(v, str) else json.dumps(v) for k, v in meta.items()} if isinstance(meta, dict) else {}
    entries = []
    for name, info in top.items():
        try:
            start, end = info["data_offsets"]
            if start > end:
                raise ValueError
            entries.append((name, info["dtype"], [int(d) for d in info["shape"]], 8 + n + start, 8 + n + end))
        except (KeyError, TypeError, ValueError):
            raise ValueError(f"bad entry for {name}") from None
    return metadata, sorted(entries, key=lambda e: (e[3], e[0]))


class _Cursor:
    """Little-endian reads from a file handle; short reads raise."""

    def __init__(self, handle):
        self.handle = handle

    def take(self, n: int) -> bytes:
        data = self.handle.read(n)
        if len(data) < n:
            raise ValueError("truncated header")
        return data

    def number(self, fmt: str):
        return struct.unpack(fmt, self.take(struct.calcsize(fmt)))[0]

    def string(self) -> str:
        n = self.number("<Q")
        if n >= 64 << 20:
            raise ValueError(f"string length {n}")
        return self.take(n).decode("utf-8", "replace")

    def value(self, kind: int) -> str:
        if kind in SCALARS:
            v = self.number(SCALARS[kind])
            return str(v).lower() if kind == 7 else str(v)
        if kind == 8:
            return self.string()
        if kind == 9:
            inner, count = self.number("<I"), self.number("<Q")
            items = []
            for i in range(count):
                item = self.value(inner)
                if i < PREVIEW:
                    items.append(item)
            return "[" + ", ".join(items) + (f", … ({count})" if count > len(items) else "") + "]"
        raise ValueError(f"unknown value type {kind}")


def read_gguf_header(handle) -> tuple[int, dict[str, str], list[tuple]]:
    """version, metadata and (name, type name, row-major shape, offset)."""
    c = _Cursor(handle)
    if c.take(4) != b"GGUF":
        raise ValueError("not a GGUF file")
    version = c.number("<I")
    if version not in (2, 3):
        raise ValueError(f"unsupported version {version}")
    tensors, pairs = c.number("<Q"), c.number("<Q")
    if tensors >= MAX_COUNT or pairs >= MAX_COUNT:
        raise ValueError("implausible counts")
    metadata = {}
    for _ in range(pairs):
        key = c.string()
        metadata[key] = c.value(c.number("<I"))
    entries = []
    for _ in range(tensors):
        name, dims = c.string(), c.number("<I")
        if dims > 8:
            raise ValueError(f"tensor {name} has {dims} dims")
        shape = [c.number("<Q") for _ in range(dims)][::-1]
        kind, offset = c.number("<I"), c.number("<Q")
        entries.append((name, GGML_TYPES.get(kind, f"type_{kind}"), shape, offset))
    return version, metadata, entries


class _Batch(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, path: str, pattern: str, gguf: bool):
        self.path, self.pattern, self.gguf = path, pattern, gguf
        self.tests: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Conditions on ``path`` leave other files unopened; Spark tests every condition again on the rows."""
        checks = {EqualTo: lambda p, v: p == v, In: lambda p, v: p in v, StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: lambda p, v: v in p}
        for f in filters:
            if type(f) in checks and f.attribute == ("path",):
                self.tests.append((checks[type(f)], f.value))
            yield f

    def partitions(self) -> list[InputPartition]:
        files = [f for f in list_files(self.path, self.pattern) if all(check(f[0], value) for check, value in self.tests)]
        return [_Batch(files[i:i + FILES_PER_TASK]) for i in range(0, len(files), FILES_PER_TASK)] or [_Batch([])]

    def read(self, partition: _Batch) -> Iterator[tuple]:
        for path, size in partition.files:
            try:
                with open_header(path) as handle:
                    if self.gguf:
                        version, metadata, entries = read_gguf_header(handle)
                        rows = [(n, t, s, o, None) for n, t, s, o in entries]
                    else:
                        version = None
                        metadata, rows = read_tensor_header(handle)
            except Exception as error:  # the row carries the reason
                yield path, size, None, None, None, None, None, None, None, str(error)
                continue
            for name, dtype, shape, start, end in rows or [(None, None, None, None, None)]:
                yield path, size, name, dtype, shape, start, end, metadata, version, None


class TensorHeaders(DataSource):
    """``spark.read.format("tensor_headers").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "tensor_headers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("pattern", "*.safetensors"), False)


class GgufHeaders(TensorHeaders):
    """``spark.read.format("gguf_headers").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "gguf_headers"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("pattern", "*.gguf"), True)


def scan_headers(spark: SparkSession, folder: str, gguf: bool = False) -> DataFrame:
    """One row per tensor; unreadable files keep one row with ``error``."""
    source = GgufHeaders if gguf else TensorHeaders
    spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(source.name()).load(folder)


def shard_index(spark: SparkSession, folder: str) -> DataFrame:
    """(unit, shard) of ``*.safetensors.index.json`` files; unreadable ones are skipped."""
    text = (spark.read.option("pathGlobFilter", "*.safetensors.index.json").option("recursiveFileLookup", "true").text(folder, wholetext=True)
            .select("value", F.col("_metadata.file_path").alias("index_path")))
    names = F.from_json("value", "weight_map map<string,string>")["weight_map"]
    here = F.regexp_replace("index_path", "/[^/]*$", "")
    return (text.withColumn("_d", here).select(F.regexp_replace("index_path", r"\.index\.json$", "").alias("unit"), "_d", F.explode(F.map_values(names)).alias("_s"))
            .select("unit", F.concat("_d", F.lit("/"), "_s").alias("shard")).distinct())


def decode(raw: bytes, dtype: str, count: int) -> np.ndarray:
    """Little-endian elements as doubles; the byte count has to match."""
    if dtype not in BYTE_SIZES:
        raise ValueError(f"unsupported element type {dtype}")
    if len(raw) != count * BYTE_SIZES[dtype]:
        raise ValueError(f"expected {count * BYTE_SIZES[dtype]} bytes, got {len(raw)}")
    if dtype == "BF16":
        return (np.frombuffer(raw, "<u2").astype("u4") << 16).view("f4").astype("f8")
    if dtype in ("F8_E4M3", "F8_E5M2"):
        return _eight_bit(np.frombuffer(raw, "u1"), *((4, 3, 7) if dtype == "F8_E4M3" else (5, 2, 15)))
    kind = {"F": "f", "I": "i", "U": "u", "B": "u"}[dtype[0]]
    return np.frombuffer(raw, f"<{kind}{BYTE_SIZES[dtype]}").astype("f4").astype("f8") if dtype != "F64" else np.frombuffer(raw, "<f8").astype("f4").astype("f8")


def _eight_bit(code: np.ndarray, exponent_bits: int, mantissa_bits: int, bias: int) -> np.ndarray:
    """E4M3 has no infinity and one NaN per sign; E5M2 follows IEEE."""
    exponent = (code >> mantissa_bits) & ((1 << exponent_bits) - 1)
    mantissa = (code & ((1 << mantissa_bits) - 1)).astype("f8")
    scale = 2.0 ** mantissa_bits
    value = np.where(exponent == 0, mantissa / scale * 2.0 ** (1 - bias), (1 + mantissa / scale) * 2.0 ** (exponent.astype("f8") - bias))
    if exponent_bits == 4:
        value = np.where((code & 0x7F) == 0x7F, np.nan, value)
    else:
        value = np.where(exponent == 31, np.where(mantissa == 0, np.inf, np.nan), value)
    return np.where(code & 0x80, -value, value)


CHUNK = 1 << 16


CHUNKS = "path string, name string, first bigint, values array<double>, error string"


def _decode_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow in and out: NaN payloads stay NaN, only failures are NULL."""
    types = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.float64()), pa.string()]
    names = ["path", "name", "first", "values", "error"]
    for batch in batches:
        for row in batch.to_pylist():
            n = row["count"]
            try:
                with open_file(row["path"]) as handle:
                    handle.seek(row["byte_start"] + row["first"] * row["width"])
                    values = decode(handle.read(n * row["width"]), row["dtype"], n)
                chunk = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(values, pa.float64()))
                columns = [[row["path"]], [row["name"]], [row["first"]], chunk, [None]]
            except Exception as error:  # the row carries the reason
                columns = [[row["path"]], [row["name"]], [row["first"]], [None], [str(error)]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types)], names)


def decode_chunks(tensors: DataFrame) -> DataFrame:
    """(path, name, first, values, error): catalogued tensors in chunks of at most ``CHUNK`` elements from place ``first``.

    Chunks are spread over tasks, so one huge tensor is many tasks' work; a size
    that does not match its shape is an error row.
    """
    elements = F.aggregate("shape", F.lit(1).cast("bigint"), lambda a, b: a * b)
    size = F.lit(None).cast("int")
    for name, width in BYTE_SIZES.items():
        size = F.when(F.col("dtype") == name, width).otherwise(size)
    known = tensors.where("name IS NOT NULL").withColumn("width", size).withColumn("elements", elements)
    bad = F.when(F.col("width").isNull(), F.concat(F.lit("unsupported element type "), "dtype")).when(
        F.col("byte_end") - F.col("byte_start") != F.col("elements") * F.col("width"), "byte size does not match the shape")
    checked = known.withColumn("error", bad)
    failed = checked.where("error IS NOT NULL").select("path", "name", F.lit(None).cast("bigint").alias("first"), F.lit(None).cast("array<double>").alias("values"), "error")
    good = checked.where("error IS NULL AND elements > 0").withColumn("first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("elements") - 1, F.lit(CHUNK).cast("bigint"))))
    jobs = good.select("path", "name", "dtype", "byte_start", "first", "width", F.least(F.lit(CHUNK), F.col("elements") - F.col("first")).alias("count"))
    spread = jobs.repartition(int(tensors.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", "name", "first")
    return spread.mapInArrow(_decode_chunks, CHUNKS).unionByName(failed)


def decode_payloads(tensors: DataFrame) -> DataFrame:
    """(path, name, idx, value, error): the single elements of ``decode_chunks``."""
    chunks = decode_chunks(tensors)
    each = chunks.select("path", "name", "first", "error", F.posexplode_outer("values").alias("_at", "value"))
    return each.select("path", "name", (F.col("first") + F.col("_at")).alias("idx"), "value", "error")


def file_pins(files: DataFrame) -> DataFrame:
    """(path, pin) of each distinct ``path``: ``sha256:`` and the digest, read block by block; NULL for an unreadable file."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pins = []
            for path in batch.column("path").to_pylist():
                state = hashlib.sha256()
                try:
                    with open_file(path) as handle:
                        while block := handle.read(HASH_BLOCK):
                            state.update(block)
                    pins.append(f"sha256:{state.hexdigest()}")
                except OSError:
                    pins.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(pins, pa.string())], names=["path", "pin"])

    paths = files.select("path").distinct()
    return paths.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path").mapInArrow(digest, "path string, pin string")


def local_adapters(spark: SparkSession, folder: str) -> DataFrame:
    """Tensors with the file's SHA-256 pin and its sibling config text."""
    heads = scan_headers(spark, folder)
    bare = lambda c: F.regexp_replace(c, "^file:/*", "/")
    config = spark.read.option("pathGlobFilter", "adapter_config.json").option("recursiveFileLookup", "true").text(folder, wholetext=True).select(
        F.regexp_replace(bare(F.col("_metadata.file_path")), "/[^/]*$", "").alias("_dir"), F.col("value").alias("config"))
    return (heads.join(file_pins(heads), "path", "left").withColumn("_dir", F.regexp_replace(bare(F.col("path")), "/[^/]*$", ""))
            .join(config, "_dir", "left").drop("_dir"))
