"""The audit's input shapes derived from the whole driver tables.

Each shape exists twice: as a DataFrame for the jobs and as a named SQL
fragment for the oracle. Both read every row of their tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import keyed
from palimpsest.operators.mixture import spread
from palimpsest.plans.registry import table

SIDE = 8
CELLS = SIDE * SIDE
MEAS_SIDE = 16
LEVELS = (1.0, 3.0, 5.0)
DRAWS = 2
SUFFIXES = (".lora_up.weight", ".lora_down.weight", ".alpha")
PROJECTIONS = ((0, "_attn2_to_q", 32, 32), (1, "_attn2_to_k", 32, 24), (2, "_attn2_to_v", 32, 24),
               (3, "_attn2_to_out_0", 32, 32), (4, "_ff_net_0_proj", 128, 32))


def latents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EMB: every embedding as an 8x8 grid of about unit variance."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(F.col("vec_id").alias("ref_id"), "label", F.posexplode("embedding").alias("cell", "x")).select(
        "ref_id", "label", "cell", (F.lit(8.0) * F.col("x").cast("double")).alias("value"))


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MEAS: retained variance per (image, level, draw, cell) with two planted drops in every image; cells may be missing."""
    row, col = F.expr("l_partkey % 256 div 16"), F.expr("l_partkey % 16")
    li = table(spark, sf_dir, "lineitem").select(
        F.expr("l_partkey div 256").alias("ref_id"), F.col("l_linenumber").alias("level_ix"), (F.col("l_suppkey") % 4).alias("draw"),
        (F.col("l_partkey") % 256).alias("cell"), "l_partkey", "l_discount", "l_tax", "l_quantity")
    drop = (F.when(row.between(3, 7) & col.between(3, 8), 0.5)
            .when(row.between(11, 13) & col.between(10, 14), 0.2).otherwise(0.0))
    return (li.groupBy("ref_id", "level_ix", "draw", "cell")
            .agg((F.lit(0.86) + F.avg("l_discount")).alias("rho_base"),
                 (F.lit(0.8568) + F.avg("l_tax") - F.max(drop)).alias("rho_target"),
                 (F.lit(0.6) + F.avg("l_quantity") / 80).alias("rho_uncond"),
                 (F.avg("l_quantity") / 40.3).alias("x0_base"), (F.avg("l_discount") * (1 - F.max(drop)) * 10 / 3).alias("x0_target"))
            .select("ref_id", "level_ix", F.col("draw").cast("int").alias("draw"),
                    F.col("cell").cast("int").alias("cell"), "rho_base", "rho_target", "rho_uncond", "x0_base", "x0_target"))


def byte_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNG: byte ranges per file."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 10).alias("file"),
        (F.col("l_orderkey") * 2000 + F.col("l_linenumber") * 300).alias("lo"),
        (F.col("l_orderkey") * 2000 + F.col("l_linenumber") * 300 + F.col("l_quantity").cast("bigint") * 20).alias("hi"))


def tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TENS: a tensor catalog shaped like cross-attention adapters, one unit per brand."""
    part = table(spark, sf_dir, "part")
    proj = F.explode(F.array(*[F.struct(F.lit(i).alias("pid"), F.lit(p).alias("proj"), F.lit(o).alias("outd"),
                                        F.lit(n).alias("ind")) for i, p, o, n in PROJECTIONS]))
    suffix = F.explode(F.array(*[F.lit(s) for s in SUFFIXES]))
    return (part.select("p_partkey", F.col("p_brand").alias("unit"), "p_size", proj.alias("j"))
            .where((F.col("p_partkey") % 5 == F.col("j.pid")) | F.col("j.pid").isin(1, 2))
            .select("unit", "p_size", "j", suffix.alias("suffix"))
            .select("unit", F.concat(F.lit("lora_unet_blocks_"), F.col("p_size").cast("string"), "j.proj", "suffix").alias("name"),
                    F.when(F.col("suffix") == SUFFIXES[0], F.col("j.outd")).when(F.col("suffix") == SUFFIXES[1], 4)
                    .otherwise(1).alias("d0"),
                    F.when(F.col("suffix") == SUFFIXES[0], 4).when(F.col("suffix") == SUFFIXES[1], F.col("j.ind"))
                    .otherwise(1).alias("d1"))
            .distinct())


def tensor_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TENS in the catalog's own columns (shape array, dtype, byte size)."""
    return tensors(spark, sf_dir).select(
        "unit", "name", F.lit("F32").alias("dtype"),
        F.array(F.col("d0").cast("bigint"), F.col("d1").cast("bigint")).alias("shape"),
        (F.col("d0") * F.col("d1") * 4).cast("bigint").alias("bytes"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCORE: scores with binary labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars").cast("double") / 1000.0).alias("score"))
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"), "toxic"), "doc_id")


def masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CTRL: one run per order status, masses against its own low-priority controls."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("run_id"),
        (F.col("o_totalprice") / 1000).alias("mass"),
        F.when(F.col("o_orderpriority") == "5-LOW", "control").otherwise("reference").alias("role"))


def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FACT: each vector is an 8x8 factor; vectors 4m..4m+3 are one module's four roles."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(F.expr("vec_id div 4").alias("module"), (F.col("vec_id") % 4).cast("int").alias("role"),
                      F.posexplode("embedding").alias("pos", "x")).select(
        "module", "role", F.expr("pos div 8").cast("bigint").alias("i"), (F.col("pos") % 8).cast("bigint").alias("j"),
        F.col("x").cast("double").alias("v"))


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CARD: model cards with front matter, heading and trigger line, one per customer.

    The table is a few small files, but reading a card is not small work: rows are dealt over all tasks first.
    """
    c = spread(table(spark, sf_dir, "customer"), "c_custkey")
    name = F.lower(F.translate("c_name", "#", " "))
    seg = F.lower("c_mktsegment")
    return c.select(
        F.col("c_custkey").alias("card_id"),
        F.concat(F.lit("---\nbase_model: org/"), seg, F.lit("\ntags:\n  - lora\n  - portrait\n  - "), seg,
                 F.lit("\ninstance_prompt: a photo of sks "), name, F.lit("\ntrigger_words: [\"ohwx person\", 'k"),
                 F.col("c_nationkey").cast("string"), F.lit("']\n---\n# My "), F.col("c_name"), F.lit(" LoRA\nTrigger word: `sks "),
                 name, F.lit("`; v"), F.col("c_nationkey").cast("string"), F.lit("\nTrained on "), seg,
                 F.lit(" faces, not nsfw.")).alias("readme"))


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """META: training metadata per supplier, tag counts taken from its line items."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", "l_linenumber")
    tag = F.concat(F.lit("("), F.lower("l_returnflag"), F.lit("_Tag:1."), F.col("l_linenumber").cast("string"), F.lit(") "),
                   F.when(F.col("l_linenumber") % 2 == 0, "portrait").otherwise("red_hair"))
    counts = li.select("l_suppkey", F.col("l_linestatus").alias("dir"), tag.alias("tag")).groupBy("l_suppkey", "dir", "tag").count()
    dirs = (counts.groupBy("l_suppkey", "dir")
            .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("tag", "count")))).alias("tags"),
                 F.sum("count").alias("images")))
    return (dirs.groupBy("l_suppkey")
            .agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("dir", "tags")))).alias("ss_tag_frequency"),
                 F.to_json(F.map_from_entries(F.sort_array(F.collect_list(
                     F.struct("dir", F.struct(F.col("images").alias("img_count"))))))).alias("ss_dataset_dirs"))
            .select(F.col("l_suppkey").alias("unit"), F.create_map(
                F.lit("ss_tag_frequency"), "ss_tag_frequency", F.lit("ss_dataset_dirs"), "ss_dataset_dirs",
                F.lit("modelspec.title"), F.concat(F.lit("Model "), F.col("l_suppkey").cast("string")),
                F.lit("ss_trigger_words"), F.concat(F.lit("sks person, tok"), (F.col("l_suppkey") % 7).cast("string"))).alias("metadata")))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRIAL: experiment trials."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("kind"), (F.col("user_id") % 4).alias("kappa_ix"),
        F.when(F.col("event_id") % 2 == 0, "member").otherwise("held-out").alias("label"),
        F.col("value").alias("snap"), (F.col("value") / 500).alias("collapse"),
        F.when(F.col("event_type") == "purchase", "memorized").when(F.col("event_type") == "signup", "memorized-other-content")
        .when(F.col("event_type") == "error", "inconclusive").otherwise("no-evidence").alias("verdict"))


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LOG: fetch log with status, bytes, cache flag and event time."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), (F.col("user_id") % 20).alias("scan_id"), "ts",
        F.when(F.col("event_type") == "error", 404).when(F.col("event_type") == "view", 200).otherwise(206).alias("status"),
        F.round(F.col("value") * 1000).cast("bigint").alias("bytes"), (F.col("user_id") % 3 == 0).alias("cached"))


def level_grid(spark: SparkSession, levels=LEVELS) -> DataFrame:
    return keyed.level_table(spark, levels)


# --- oracle fragments -------------------------------------------------------

def _hmac(message: str) -> str:
    inner, outer = keyed.pads(keyed.RESEARCH_KEY)
    return (f"sha256(unhex('{outer.hex()}') || unhex(sha256(unhex('{inner.hex()}') || encode({message}))))")


def sql_prf(stream: str, index: str) -> str:
    return _hmac(f"'{keyed.VERSION}|{stream}|' || {index}")


def sql_uniform(digest: str, part: int = 0) -> str:
    return f"(('0x' || substr({digest}, {1 + 13 * part}, 13))::BIGINT / 4503599627370496.0)"


def sql_normal(digest: str) -> str:
    return (f"(sqrt(-2.0 * ln(greatest({sql_uniform(digest)}, 1e-12))) * "
            f"cos(2.0 * 3.141592653589793 * {sql_uniform(digest, 1)}))")


def sql_levels(levels=LEVELS) -> str:
    values = ", ".join(f"({i}, {v!r}::DOUBLE)" for i, v in enumerate(levels))
    return f"SELECT * FROM (VALUES {values}) AS v(level_ix, level)"


def sql_draws(stream: str, count: int = DRAWS, cells: int = CELLS, levels=LEVELS) -> str:
    index = "(1000000 + round(level * 64)::BIGINT) || ':' || draw || ':' || cell"
    return (f"SELECT level_ix, level, draw, cell, {sql_normal('d')} AS eps FROM (SELECT level_ix, level, draw, cell, "
            f"{sql_prf(stream, index)} AS d FROM ({sql_levels(levels)}) l, range({count}) a(draw), range({cells}) b(cell))")


_PROJ = ", ".join(f"({i}, '{p}', {o}, {n})" for i, p, o, n in PROJECTIONS)
_SUFF = ", ".join(f"('{s}')" for s in SUFFIXES)

SQL: dict[str, str] = {
    "emb": "SELECT vec_id AS ref_id, label, i-1 AS cell, 8.0 * CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, range(1,65) t(i)",
    "meas": """SELECT ref_id, level_ix, draw, cell, 0.86 + avg(l_discount) AS rho_base, 0.8568 + avg(l_tax) - max(planted) AS rho_target,
      0.6 + avg(l_quantity) / 80 AS rho_uncond, avg(l_quantity) / 40.3::DOUBLE AS x0_base, avg(l_discount) * (1 - max(planted)) * 10 / 3 AS x0_target
      FROM (SELECT *, l_partkey // 256 AS ref_id, l_linenumber AS level_ix, l_suppkey % 4 AS draw, l_partkey % 256 AS cell,
        CASE WHEN (l_partkey % 256) // 16 BETWEEN 3 AND 7 AND (l_partkey % 16) BETWEEN 3 AND 8 THEN 0.5::DOUBLE
          WHEN (l_partkey % 256) // 16 BETWEEN 11 AND 13 AND (l_partkey % 16) BETWEEN 10 AND 14 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS planted FROM lineitem)
      GROUP BY ref_id, level_ix, draw, cell""",
    "rng": """SELECT l_suppkey % 10 AS file, l_orderkey * 2000 + l_linenumber * 300 AS lo,
      l_orderkey * 2000 + l_linenumber * 300 + CAST(l_quantity AS BIGINT) * 20 AS hi FROM lineitem""",
    "tens": f"""SELECT DISTINCT p_brand AS unit, concat('lora_unet_blocks_', CAST(p_size AS VARCHAR), j.proj, k.suffix) AS name,
      CASE k.suffix WHEN '.lora_up.weight' THEN j.outd WHEN '.lora_down.weight' THEN 4 ELSE 1 END AS d0,
      CASE k.suffix WHEN '.lora_up.weight' THEN 4 WHEN '.lora_down.weight' THEN j.ind ELSE 1 END AS d1
      FROM part JOIN (SELECT * FROM (VALUES {_PROJ}) AS v(pid,proj,outd,ind)) j ON p_partkey % 5 = j.pid OR j.pid IN (1,2)
      CROSS JOIN (SELECT * FROM (VALUES {_SUFF}) AS w(suffix)) k""",
    "score": "SELECT d.doc_id, CAST(d.n_chars AS DOUBLE)/1000.0 AS score, l.quality AS label, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
    "ctrl": """SELECT o_orderkey AS id, o_orderstatus AS run_id, o_totalprice/1000 AS mass,
      CASE WHEN o_orderpriority = '5-LOW' THEN 'control' ELSE 'reference' END AS role FROM orders""",
    "fact": """SELECT vec_id // 4 AS module, vec_id % 4 AS role, (k-1) // 8 AS i, (k-1) % 8 AS j, CAST(embedding[k] AS DOUBLE) AS v
      FROM embeddings, range(1,65) t(k)""",
    "card": """SELECT c_custkey AS card_id, concat('---', chr(10), 'base_model: org/', seg, chr(10), 'tags:', chr(10), '  - lora', chr(10),
      '  - portrait', chr(10), '  - ', seg, chr(10), 'instance_prompt: a photo of sks ', nm, chr(10),
      'trigger_words: ["ohwx person", ''k', c_nationkey, ''']', chr(10), '---', chr(10), '# My ', c_name, ' LoRA', chr(10),
      'Trigger word: `sks ', nm, '`; v', c_nationkey, chr(10), 'Trained on ', seg, ' faces, not nsfw.') AS readme
      FROM (SELECT *, lower(replace(c_name, '#', ' ')) AS nm, lower(c_mktsegment) AS seg FROM customer)""",
    "tagrows": """SELECT l_suppkey AS unit, l_linestatus AS dir, concat('(', lower(l_returnflag), '_Tag:1.', l_linenumber, ') ',
      CASE WHEN l_linenumber % 2 = 0 THEN 'portrait' ELSE 'red_hair' END) AS tag, count(*) AS n FROM lineitem GROUP BY ALL""",
    "trial": """SELECT event_id, event_type AS kind, user_id % 4 AS kappa_ix,
      CASE WHEN event_id % 2 = 0 THEN 'member' ELSE 'held-out' END AS label, value AS snap, value/500 AS collapse,
      CASE event_type WHEN 'purchase' THEN 'memorized' WHEN 'signup' THEN 'memorized-other-content'
        WHEN 'error' THEN 'inconclusive' ELSE 'no-evidence' END AS verdict FROM events""",
    "log": """SELECT event_id AS request_id, user_id % 20 AS scan_id, ts,
      CASE event_type WHEN 'error' THEN 404 WHEN 'view' THEN 200 ELSE 206 END AS status,
      CAST(round(value*1000) AS BIGINT) AS bytes, user_id % 3 = 0 AS cached FROM events""",
    "levels": sql_levels(),
    "draws": sql_draws("noise"),
}


def with_sql(names: list[str], select: str, **extra: str) -> str:
    """``WITH`` the named fragments (and extra ones, in order) ``select``."""
    parts = [f"{n} AS MATERIALIZED ({SQL[n]})" for n in names]
    parts += [f"{n} AS MATERIALIZED ({text})" for n, text in extra.items()]
    return f"WITH {', '.join(parts)} {select}"
