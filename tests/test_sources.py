"""Files built byte by byte."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import adapters, basin, catalog, heat, matrices, textmeta
from palimpsest.sources import media, tensor_files


def safetensors(path, tensors, metadata=None):
    head, body, at = {}, b"", 0
    if metadata:
        head["__metadata__"] = metadata
    for name, dtype, shape, raw in tensors:
        head[name] = {"dtype": dtype, "shape": shape, "data_offsets": [at, at + len(raw)]}
        body, at = body + raw, at + len(raw)
    text = json.dumps(head).encode()
    path.write_bytes(struct.pack("<Q", len(text)) + text + body)


def test_headers_payloads_and_bad_files(spark, tmp_path):
    safetensors(tmp_path / "a.safetensors", [
        ("h", "F16", [2, 2], struct.pack("<4H", 0x3C00, 0xC000, 0x7BFF, 0x0001)), ("w", "F32", [2], struct.pack("<2f", 1.5, -2)),
        ("e4", "F8_E4M3", [4], bytes([0x38, 0x7E, 0x7F, 0xB8])), ("e5", "F8_E5M2", [2], bytes([0x3C, 0x7C])),
        ("b", "BF16", [1], struct.pack("<H", 0x3FC0)), ("i", "I16", [2], struct.pack("<2h", -3, 7)), ("short", "F32", [3], b"\0" * 8)], {"k": "v"})
    (tmp_path / "bad.safetensors").write_bytes(struct.pack("<Q", 10**9))
    (tmp_path / "cut.safetensors").write_bytes(b"abc")
    heads = tensor_files.scan_headers(spark, str(tmp_path))
    rows = heads.collect()
    assert {r["name"] for r in rows if r["error"] is None} == {"h", "w", "e4", "e5", "b", "i", "short"}
    assert sum(r["error"] is not None for r in rows) == 2
    assert all(r["metadata"] == {"k": "v"} for r in rows if r["error"] is None)
    got = {}
    for r in tensor_files.decode_payloads(heads).collect():
        got.setdefault(r["name"], []).append((r["idx"], r["value"], r["error"]))
    values = {k: [v for _, v, _ in sorted(x)] for k, x in got.items() if k != "short"}
    assert values["h"] == [1.0, -2.0, 65504.0, 5.960464477539063e-08]
    assert values["w"] == [1.5, -2.0] and values["b"] == [1.5] and values["i"] == [-3.0, 7.0]
    assert values["e4"][:2] == [1.0, 448.0] and values["e4"][3] == -1.0 and np.isnan(values["e4"][2])
    assert values["e5"] == [1.0, float("inf")]
    assert "does not match" in got["short"][0][2]


def test_filters_on_the_path_open_no_other_file(spark, tmp_path):
    """A file that is no tensor file gives an error row only where it is opened."""
    for k in range(6):
        safetensors(tmp_path / f"m{k}.safetensors", [("w", "F32", [1], b"\0" * 4)])
    (tmp_path / "bad.safetensors").write_bytes(b"abc")
    heads = tensor_files.scan_headers(spark, str(tmp_path))
    assert heads.where(F.col("path").endswith("/m3.safetensors")).count() == 1
    reader = tensor_files._Reader(str(tmp_path), "*.safetensors", False)
    wanted = [tensor_files.StringEndsWith(("path",), "/m3.safetensors"), tensor_files.StringContains(("path",), "m"), tensor_files.EqualTo(("name",), "w")]
    assert list(reader.pushFilters(wanted)) == wanted  # Spark tests them again
    assert [f[0].rsplit("/", 1)[1] for p in reader.partitions() for f in p.files] == ["m3.safetensors"]
    assert heads.where("error IS NOT NULL").count() == 1
    chunks = tensor_files.decode_chunks(heads).collect()
    assert len(chunks) == 6 and all(c["values"] == [0.0] and c["first"] == 0 for c in chunks)


def test_shard_index_and_local_adapter(spark, tmp_path):
    (tmp_path / "m.safetensors.index.json").write_text(json.dumps({"weight_map": {"a": "1.safetensors", "b": "2.safetensors", "c": "1.safetensors"}}))
    (tmp_path / "x.safetensors.index.json").write_text("not json")
    assert sorted(r["shard"].rsplit("/", 1)[1] for r in tensor_files.shard_index(spark, str(tmp_path)).collect()) == ["1.safetensors", "2.safetensors"]
    safetensors(tmp_path / "ad.safetensors", [("m.lora_A.weight", "F32", [1, 1], b"\0" * 4)])
    (tmp_path / "adapter_config.json").write_text('{"r": 4, "lora_alpha": 16, "use_rslora": true}')
    row = tensor_files.local_adapters(spark, str(tmp_path)).first()
    assert row["pin"].startswith("sha256:") and json.loads(row["config"])["r"] == 4
    scale = spark.createDataFrame([(row["config"],), ('{"r": 8, "lora_alpha": 16}',)], "c string").select(adapters.config_scale(F.col("c"), F.lit(8)))
    assert [r[0] for r in scale.collect()] == [8.0, 2.0]


def test_gguf_header(spark, tmp_path):
    def text(s):
        return struct.pack("<Q", len(s)) + s.encode()

    raw = (b"GGUF" + struct.pack("<IQQ", 3, 1, 2) + text("general.name") + struct.pack("<I", 8) + text("toy")
           + text("list") + struct.pack("<IIQ", 9, 4, 10) + struct.pack("<10I", *range(10)) + text("blk.0.w") + struct.pack("<IQQIQ", 2, 64, 32, 12, 0))
    (tmp_path / "t.gguf").write_bytes(raw)
    (tmp_path / "n.gguf").write_bytes(b"nope")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in tensor_files.scan_headers(spark, str(tmp_path), gguf=True).collect()}
    t = rows["t.gguf"]
    assert (t["name"], t["dtype"], t["shape"], t["version"]) == ("blk.0.w", "Q4_K", [32, 64], 3)
    assert t["metadata"]["general.name"] == "toy" and t["metadata"]["list"].endswith("… (10)]")
    assert rows["n.gguf"]["error"] is not None


def png(path, width, height, pixel):
    raw = b"".join(b"\0" + bytes(v for x in range(width) for v in pixel(x, y)) for y in range(height))

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_latents_and_control_listing(spark, tmp_path):
    png(tmp_path / "b.PNG", 8, 4, lambda x, y: (255, 0, 0) if x < 4 else (0, 0, 255))
    (tmp_path / "note.txt").write_text("x")
    assert [r["name"] for r in media.control_files(spark, str(tmp_path)).collect()] == ["b.PNG"]
    (tmp_path / "note.txt").unlink()
    got = {r["cell"]: r["value"] for r in media.image_latents(spark, str(tmp_path), 2).collect()}
    assert got[0] == pytest.approx((0.2126 - 0.5) / 0.25) and got[1] == pytest.approx((0.0722 - 0.5) / 0.25) and len(got) == 4


def test_unreadable_images_keep_a_row(spark, tmp_path):
    png(tmp_path / "b.PNG", 8, 4, lambda x, y: (255, 0, 0))
    (tmp_path / "broken.png").write_bytes(b"\x89PNG\r\n\x1a\nnothing")
    (tmp_path / "note.txt").write_text("x")
    got = media.image_latents(spark, str(tmp_path), 2).collect()
    assert sorted((r["path"].split("/")[-1], r["cell"] is None, r["value"] is None, r["error"]) for r in got) == [("b.PNG", False, False, None)] * 4 + [("broken.png", True, True, "unreadable")]


def test_manifest_defaults(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"name": "x", "toy": {"side": 8, "memorization": {"kappas": [0, 1]}}}')
    row = media.manifest(spark, str(tmp_path / "m.json")).first()
    assert (row["side"], row["identities"], row["kappas"], row["members"], row["identityWeight"]) == (8, 3, [0.0, 1.0], 8, 0.05)


def test_report_numbers_are_spelled_out(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (1.5,)], "v double")
    assert [r[0] for r in df.select(media.plain(F.col("v"))).collect()] == ["inf", "-inf", "nan", "1.5"]


def test_kronecker_literal(spark):
    def m(values):
        return spark.createDataFrame([("k", i, j, float(v)) for i, row in enumerate(values) for j, v in enumerate(row)], "module string, i bigint, j bigint, v double")

    one = spark.createDataFrame([("k", 1.0)], "module string, scale double")
    out = matrices.kronecker_update(m([[1, 2], [3, 4]]), m([[0, 1], [1, 0]]), one, ["module"]).orderBy("i", "j")
    assert [r["v"] for r in out.collect()] == [0, 1, 0, 2, 1, 0, 2, 0, 0, 3, 0, 4, 3, 0, 4, 0]


def test_low_rank_spectrum_equals_dense(spark):
    rng = np.random.default_rng(0)
    up, down = rng.normal(size=(30, 4)), rng.normal(size=(4, 20))

    def m(a):
        return spark.createDataFrame([("m", i, j, float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])], "module string, i bigint, j bigint, v double")

    scale = spark.createDataFrame([("m", 0.5)], "module string, scale double")
    sig, u1 = matrices.low_rank_spectrum(m(up), m(down), scale, ["module"])
    got = sorted((r["sigma"] for r in sig.collect()), reverse=True)
    u, s, _ = np.linalg.svd(0.5 * up @ down)
    assert np.allclose(got, s[:4], rtol=1e-6)
    v = np.array([r["v"] for r in u1.orderBy("i").collect()])
    assert np.allclose(np.abs(v), np.abs(u[:, 0]), atol=1e-6) and v[np.abs(v).argmax()] > 0
    dense = sorted((r["sigma"] for r in matrices.dense_spectrum(m(0.5 * up @ down), ["module"]).collect()), reverse=True)
    assert np.allclose(dense[:4], s[:4], rtol=1e-6)
    block = {(r["i"], r["j"]): r["v"] for r in matrices.matmul(m(up), m(down), ["module"], 0.5, block=7).collect()}
    assert all(abs(block[i, j] - 0.5 * (up @ down)[i, j]) < 1e-9 for i in range(30) for j in range(20))


@pytest.mark.parametrize("elements", [1 << 22, 90])
def test_dense_svd_of_any_shape(spark, monkeypatch, elements):
    """Tall, wide, square, rank-deficient and zero modules, whole and cut into many column blocks."""
    monkeypatch.setattr(matrices, "BLOCK_ELEMENTS", elements)
    rng = np.random.default_rng(3)
    mats = {"tall": rng.normal(size=(30, 11)), "wide": rng.normal(size=(7, 25)), "square": rng.normal(size=(20, 20)) * np.logspace(0, -9, 20), "low": rng.normal(size=(18, 3)) @ rng.normal(size=(3, 14)),
            "zero": np.zeros((4, 5)), "one": np.array([[-2.0]])}
    rows = [(m, i, j, float(v)) for m, a in mats.items() for (i, j), v in np.ndenumerate(a)]
    sig, u1 = matrices.dense_svd(spark.createDataFrame(rows, "module string, i bigint, j bigint, v double"), ["module"])
    values, vectors = {}, {}
    for r in sig.orderBy("module", "k").collect():
        values.setdefault(r["module"], []).append(r["sigma"])
    for r in u1.orderBy("module", "i").collect():
        vectors.setdefault(r["module"], []).append(r["v"])
    for m, a in mats.items():
        u, s, _ = np.linalg.svd(a)
        assert np.allclose(values[m], s, rtol=1e-9, atol=1e-12), m
        if m != "zero":
            v = np.array(vectors[m])
            assert np.allclose(np.abs(v), np.abs(u[:, 0]), atol=1e-8) and v[np.abs(v).argmax()] > 0


def test_low_rank_spectrum_beyond_a_side(spark, monkeypatch):
    """A rank above both sides, and factors cut into many rows."""
    monkeypatch.setattr(matrices, "FACTOR_ROWS", 3)
    monkeypatch.setattr(matrices, "FAN_IN", 2)
    rng = np.random.default_rng(4)
    for out, rank, inner in ((5, 9, 4), (40, 3, 33), (6, 6, 2)):
        up, down = rng.normal(size=(out, rank)), rng.normal(size=(rank, inner))
        m = lambda a: spark.createDataFrame([("m", i, j, float(v)) for (i, j), v in np.ndenumerate(a)], "module string, i bigint, j bigint, v double")
        sig, u1 = matrices.low_rank_spectrum(m(up), m(down), spark.createDataFrame([("m", -0.5)], "module string, scale double"), ["module"])
        u, s, _ = np.linalg.svd(-0.5 * up @ down)
        assert np.allclose([r["sigma"] for r in sig.orderBy("k").collect()], s[: min(out, rank, inner)], rtol=1e-9)
        assert np.allclose(np.abs([r["v"] for r in u1.orderBy("i").collect()]), np.abs(u[:, 0]), atol=1e-8)


def test_photo_scale_is_the_upper_median_of_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [("a", i, [float(x) for x in rng.normal(size=5)]) for i in range(41)] + [("b", 99, [0.0] * 5)] + [("c", i, [1.0] * 5) for i in range(9)]
    got = {r["k"]: r["scale"] for r in basin.photo_scale(spark.createDataFrame(rows, "k string, id bigint, vec array<double>"), ["k"], 5.0).collect()}
    v = [np.array(r[2]) for r in rows if r[0] == "a"]
    d = sorted(((v[i] - v[j]) ** 2).sum() / 5 for i in range(41) for j in range(i + 1, 41))
    assert got["a"] == pytest.approx(d[len(d) // 2]) and got["b"] is None and got["c"] == 0.0


def test_half_radius_and_blend_literals(spark):
    rows = [(k, b, r) for k, rs in enumerate(([1, 0.5, 0], [0.4, 0.2, 0], [1, 1, 1])) for b, r in zip((0.0, 0.5, 1.0), rs)]
    got = basin.half_radius(spark.createDataFrame([(k, b, float(r)) for k, b, r in rows], "k int, beta double, rate double"), ["k"])
    assert {r["k"]: r["half_radius"] for r in got.collect()} == {0: 0.5, 1: 0.0, 2: 1.0}
    m = spark.createDataFrame([(1.0,), (0.0,), (0.6,), (0.8,)], "m double").select(basin.blend(F.lit(1.0), F.lit(0.0), F.col("m")))
    assert [r[0] for r in m.collect()] == [1.0, 0.0, 0.6, 0.8]


def test_cell_rect_literal(spark):
    row = spark.range(1).select(*heat.cell_rect(F.lit(1), F.lit(3), (20.0, 10.0, 80.0, 40.0), 2, 4)).first()
    assert tuple(row) == (80.0, 30.0, 20.0, 20.0)


def test_normalize_and_tags(spark):
    df = spark.createDataFrame([("(Red_Hair:1.2)",), ("  Long   hair, ",)], "s string")
    assert [r[0] for r in df.select(textmeta.normalize(F.col("s"))).collect()] == ["red hair", "long hair"]
    meta = {"ss_tag_frequency": json.dumps({"d1": {"ohwx woman": 20, "red_hair": 10}, "d2": {"Red hair": 5, "smile": 8}})}
    tags = textmeta.tag_rows(spark.createDataFrame([("u", meta)], "unit string, metadata map<string,string>"))
    assert textmeta.tag_totals(tags).first()["total"] == 43
    top = textmeta.top_tags(tags, 64).orderBy("rank").collect()
    assert (top[0]["tag"], top[1]["tag"], top[1]["count"]) == ("ohwx woman", "red hair", 15)


def test_front_matter(spark):
    card = "---\nbase_model: 'a/b'\ntags:\n- x\n  - \"y\"\nlist: [1, 'two']\n  nested: no\nempty:\n---\nkey: after"
    got = spark.createDataFrame([(card,), ("no block",)], "t string").select(textmeta.front_matter(F.col("t"))).collect()
    assert got[0][0] == {"base_model": ["a/b"], "tags": ["x", "y"], "list": ["1", "two"]} and got[1][0] == {}


def walk_front_matter(text):
    """The block line by line."""
    lines = text.split("\n")
    out, key, items = {}, None, []
    bare = lambda s: s.strip(" \t").strip("\"'")
    if lines[0].strip(" \t") != "---":
        return {}
    for line in [*lines[1:], "---"]:
        if line.strip(" \t") == "---":
            break
        if line.strip(" \t").startswith("- ") and key is not None:
            items.append(bare(line.strip(" \t")[2:]))
        elif not line.startswith(" ") and ":" in line:
            if items:
                out[key] = items
            key, value, items = line.split(":")[0].strip(" \t"), line.split(":", 1)[1].strip(" \t"), []
            if value.startswith("[") and value.endswith("]"):
                out[key] = [bare(v) for v in value[1:-1].split(",") if v]
            elif value:
                out[key] = [bare(value)]
    if items:
        out[key] = items
    return out


def test_front_matter_line_by_line(spark):
    rng = np.random.default_rng(7)
    pieces = ["---", " --- ", "a: 1", "b: [x, 'y',, z ]", "c:", "- i1", "  - \"i2\"", "\t- i3", "- k: v", " d: 4", "a: 'again'", "a:", "e: []", "f: [", "no colon", "", "g : u:v ", "-", "h: - x"]
    texts = ["\n".join(["---"] * (rng.random() < 0.9) + [str(p) for p in rng.choice(pieces, rng.integers(0, 9))]) for _ in range(300)] + ["", "---", "---\n---", "- k: v"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", textmeta.front_matter(F.col("t")).alias("m")).collect()
    for r in got:
        assert r["m"] == walk_front_matter(texts[r["i"]]), texts[r["i"]]


def test_very_long_cards_and_units(spark):
    """A card of 100,000 list lines and 2,000 keys, and a fetch plan over 50,000 modules of one unit."""
    card = "---\ntags:\n" + "".join(f"  - tag {i}\n" for i in range(100_000)) + "".join(f"key{i % 1500}: {i}\n" for i in range(2000)) + "---\nbody"
    m = spark.createDataFrame([(card,)], "t string").select(textmeta.front_matter(F.col("t")).alias("m")).first()["m"]
    assert len(m) == 1501 and m["tags"][-1] == "tag 99999" and len(m["tags"]) == 100_000 and m["key3"] == ["1503"] and m["key1400"] == ["1400"]
    costs = [int(c) for c in np.random.default_rng(1).integers(1, 1000, 50_000)]
    for most in (None, 700):
        left, want = 5_000_000, []
        for c in costs:
            want.append(c <= left and (most is None or sum(want) < most))
            left -= c * want[-1]
        got = spark.createDataFrame([(costs,), ([],)], "c array<bigint>").select(adapters._affordable(F.col("c"), 5_000_000, most).alias("t")).collect()
        assert got[0]["t"] == want and got[1]["t"] == []


def test_only_short_files_are_pointers(spark):
    text = "version https://git-lfs.github.com/spec/v1\noid sha256:ab\nsize 5000\n"
    files = spark.createDataFrame([("r", f"{n}.safetensors", s) for n, s in (("short", 1023), ("long", 1024), ("unknown", None))] + [("r", "x.txt", 100)], "repo string, path string, size bigint")
    texts = files.select("repo", "path", F.lit(text).alias("content"))
    got = {r["path"]: (r["size"], r["oid"]) for r in catalog.resolve_pointers(files, texts).collect()}
    assert got == {"short.safetensors": (5000, "ab"), "long.safetensors": (1024, None), "unknown.safetensors": (None, None), "x.txt": (100, None)}


def test_variants_and_links(spark):
    files = spark.createDataFrame([("lora_v2.safetensors", 10), ("lora_v2.fp16.safetensors", None), ("unet/model.safetensors", 9), ("unet/model.fp16.safetensors", 5)], "path string, size bigint")
    kept = catalog.dedupe_variants(files.withColumn("r", F.lit(0)).withColumn("ord", F.col("path")), ["r"], "ord")
    assert sorted(r["path"] for r in kept.collect()) == ["lora_v2.safetensors", "unet/model.fp16.safetensors"]
    links = spark.createDataFrame([("huggingface.co/a/b/tree/main/x/y",), ("https://github.com/o/r.git",), ("github.com/o/r/releases/download/v1/f.bin",), ("huggingface.co/datasets/x",), ("ftp",)], "link string")
    got = catalog.parse_links(links).collect()
    assert (got[0]["repo"], got[0]["revision"], got[0]["path"]) == ("a/b", "main", "x/y") and got[1]["repo"] == "o/r"
    assert (got[2]["release_tag"], got[2]["release_asset"]) == ("v1", "f.bin") and got[3]["error"] and got[4]["error"]
