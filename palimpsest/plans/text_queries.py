"""Registered queries: model cards and training metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import textmeta as tm
from palimpsest.plans import bindings as b
from palimpsest.plans.registry import query, table
from palimpsest.session import materialized


def sql_norm(x):
    y = f"replace(lower({x}), '_', ' ')"
    y = f"regexp_replace({y}, ':[0-9.]+', '', 'g')"
    y = f"regexp_replace({y}, '[()\\[\\]{{}}\"<>]', '', 'g')"
    y = f"regexp_replace({y}, '\\s+', ' ', 'g')"
    return f"regexp_replace({y}, '^[\\s\\p{{P}}]+|[\\s\\p{{P}}]+$', '', 'g')"


def joined(column, name):
    return F.array_join(column, "|").alias(name)


@query("a11_card_source", b.with_sql(["card"], "SELECT card_id, length(readme) AS n FROM card"))
def _(spark, sf):
    return b.cards(spark, sf).select("card_id", F.length("readme").cast("bigint").alias("n"))


@query("d1_normalize", f"""SELECT t, {sql_norm('t')} AS norm FROM (SELECT DISTINCT concat('  (', unnest(string_split(text, ' ')), '_X:1.2)  ') AS t FROM conversations)""")
def _(spark, sf):
    words = table(spark, sf, "conversations").select(F.explode(F.split("text", " ")).alias("w")).select(F.concat(F.lit("  ("), "w", F.lit("_X:1.2)  ")).alias("t")).distinct()
    return words.select("t", tm.normalize(F.col("t")).alias("norm"))


_TAGS = f"SELECT unit, nt AS tag, sum(n)::BIGINT AS count FROM (SELECT unit, {sql_norm('tag')} AS nt, n FROM tagrows) WHERE nt <> '' GROUP BY unit, nt"


@query("d2_tag_histogram", b.with_sql(["tagrows"], f"SELECT * FROM (SELECT unit, tag, count, row_number() OVER (PARTITION BY unit ORDER BY count DESC, tag) AS rank FROM ({_TAGS})) WHERE rank <= 64"))
def _(spark, sf):
    return tm.top_tags(tm.tag_rows(b.headers(spark, sf)), 64).select("unit", "tag", "count", F.col("rank").cast("bigint").alias("rank"))


@query("d3_image_count", b.with_sql(["tagrows"], "SELECT unit, sum(n)::BIGINT AS images FROM tagrows GROUP BY unit"))
def _(spark, sf):
    return b.headers(spark, sf).select("unit", tm.image_count(F.col("metadata")).alias("images"))


@query("d4_split_list", """SELECT conv_id, turn, array_to_string(list_transform(list_filter(regexp_split_to_array(text, '[,\\n;]'), lambda x: x <> ''), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), '|') AS items FROM conversations""")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", joined(tm.split_list(F.col("text")), "items"))


def carded(spark, sf):
    """Cards with their front matter, joined to a unit's training metadata."""
    cards = b.cards(spark, sf).withColumn("card", tm.front_matter(F.col("readme")))
    suppliers = table(spark, sf, "supplier").agg(F.max("s_suppkey").alias("n")).scalar()
    return materialized(cards.withColumn("unit", 1 + F.col("card_id") % suppliers).join(b.headers(spark, sf), "unit", "left"), "cards")


_CARD = """SELECT *, 1 + card_id % (SELECT max(s_suppkey) FROM supplier) AS unit FROM (SELECT c_custkey AS card_id, nm, seg, c_name, c_nationkey FROM (SELECT *, lower(replace(c_name, '#', ' ')) AS nm, lower(c_mktsegment) AS seg FROM customer))"""


@query("d5_trigger_words", f"""SELECT card_id, concat_ws('|', CASE WHEN has THEN 'sks person|tok' || (unit % 7) END, 'a photo of sks ' || nm, 'ohwx person', 'k' || c_nationkey, 'sks ' || nm) AS triggers
  FROM (SELECT c.*, l.unit IS NOT NULL AS has FROM ({_CARD}) c LEFT JOIN (SELECT DISTINCT l_suppkey AS unit FROM lineitem) l ON l.unit = c.unit)""")
def _(spark, sf):
    c = carded(spark, sf)
    return c.select("card_id", joined(tm.trigger_words(F.col("metadata"), F.col("card"), F.col("readme")), "triggers"))


@query("d6_trigger_lines", b.with_sql(["card"], """SELECT card_id, array_to_string(list_transform(regexp_extract_all(readme, '(?im)trigger(?:\\s*(?:word|words|phrase|token))?s?\\s*[:：]\\s*`?([^`\\n]+)`?', 1), lambda x: trim(x)), '|') AS lines FROM card"""))
def _(spark, sf):
    return b.cards(spark, sf).select("card_id", joined(tm.trigger_lines(F.col("readme")), "lines"))


@query("d7_base_and_title", f"""SELECT card_id, 'org/' || seg AS base_model, CASE WHEN has THEN 'Model ' || unit ELSE 'My ' || c_name || ' LoRA' END AS title
  FROM (SELECT c.*, l.unit IS NOT NULL AS has FROM ({_CARD}) c LEFT JOIN (SELECT DISTINCT l_suppkey AS unit FROM lineitem) l ON l.unit = c.unit)""")
def _(spark, sf):
    c = carded(spark, sf)
    m, k, r = F.col("metadata"), F.col("card"), F.col("readme")
    return c.select("card_id", tm.base_model(m, k).alias("base_model"), tm.title(m, k, r).alias("title"))


@query("d8_first_heading", "SELECT c_custkey AS card_id, 'My ' || c_name || ' LoRA' AS heading FROM customer")
def _(spark, sf):
    return b.cards(spark, sf).select("card_id", tm.first_heading(F.col("readme")).alias("heading"))


def _sql_found(terms, corpus):
    words = ", ".join(f"'{t}'" for t in terms if " " not in t)
    phrases = ", ".join(f"'{t}'" for t in terms if " " in t)
    return (f"array_to_string(list_sort(list_distinct(flatten(list_transform({corpus}, lambda t: list_concat(list_intersect(string_split(t, ' '), [{words}]), "
            f"list_filter([{phrases}]::VARCHAR[], lambda p: contains(t, p))))))), '|')")


@query("d9_indicators", f"""SELECT doc_id, {_sql_found(tm.PERSON_TERMS, 'c')} AS person, {_sql_found(tm.NSFW_TERMS, 'c')} AS nsfw FROM (SELECT doc_id,
  list_transform(list_filter(regexp_split_to_array(text, '\\r?\\n'), lambda x: x <> ''), lambda x: {sql_norm('x')}) AS c FROM documents)""")
def _(spark, sf):
    lines = F.filter(F.split("text", r"\r?\n"), lambda s: s != "")
    d = table(spark, sf, "documents").select("doc_id", F.transform(lines, tm.normalize).alias("c"))
    return d.select("doc_id", joined(tm.indicators(F.col("c"), tm.PERSON_TERMS), "person"), joined(tm.indicators(F.col("c"), tm.NSFW_TERMS), "nsfw"))


@query("d9_card_indicators", f"""SELECT card_id, array_to_string(list_sort(list_filter(['person', 'portrait', 'ohwx person', 'sks person'], lambda x: x <> 'sks person' AND x <> 'person' OR x = 'person' OR has)), '|') AS person, 'nsfw' AS nsfw
  FROM (SELECT c.*, l.unit IS NOT NULL AS has FROM ({_CARD}) c LEFT JOIN (SELECT DISTINCT l_suppkey AS unit FROM lineitem) l ON l.unit = c.unit)""")
def _(spark, sf):
    c = carded(spark, sf)
    m, k, r = F.col("metadata"), F.col("card"), F.col("readme")
    none = F.array().cast("array<string>")
    text = tm.corpus(none, tm.trigger_words(m, k, r), none, k, tm.title(m, k, r), r)
    rows = c.select("card_id", text.alias("c"))
    return rows.select("card_id", joined(tm.indicators(F.col("c"), tm.PERSON_TERMS), "person"), joined(tm.indicators(F.col("c"), tm.NSFW_TERMS), "nsfw"))


@query("d10_front_matter", f"""SELECT card_id, 'base_model' AS key, 'org/' || seg AS vals FROM ({_CARD}) UNION ALL SELECT card_id, 'tags', 'lora|portrait|' || seg FROM ({_CARD})
  UNION ALL SELECT card_id, 'instance_prompt', 'a photo of sks ' || nm FROM ({_CARD}) UNION ALL SELECT card_id, 'trigger_words', 'ohwx person|k' || c_nationkey FROM ({_CARD})""")
def _(spark, sf):
    rows = b.cards(spark, sf).select("card_id", F.explode(tm.front_matter(F.col("readme"))).alias("key", "v"))
    return rows.select("card_id", "key", joined(F.col("v"), "vals"))


@query("d11_weighted_terms", b.with_sql(["tagrows"], f"""SELECT unit, term, round(weight, 6) AS weight FROM (SELECT unit, tag AS term, count / sum(count) OVER (PARTITION BY unit) AS weight FROM ({_TAGS})
  UNION ALL SELECT unit, unnest(['sks person', 'tok' || (unit % 7)]), 0.5 FROM (SELECT DISTINCT unit FROM tagrows) UNION ALL SELECT unit, unnest(['lora', 'portrait x']), 0.1 FROM (SELECT DISTINCT unit FROM tagrows)
  UNION ALL SELECT unit, 'model ' || unit, 0.2 FROM (SELECT DISTINCT unit FROM tagrows))"""))
def _(spark, sf):
    h = materialized(b.headers(spark, sf), "headers")
    tags = tm.tag_rows(h)
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<string>>"))
    found = h.select("unit", tm.trigger_words(F.col("metadata"), none, F.lit(None).cast("string")).alias("triggers"), F.array(F.lit("lora"), F.lit("Portrait_X"), F.lit("()")).alias("hub_tags"),
                     tm.title(F.col("metadata"), none, F.lit(None).cast("string")).alias("title"))
    return tm.weighted_terms(tags, tm.tag_totals(tags), found).select("unit", "term", F.round("weight", 6).alias("weight"))


@query("d12_json_strings", """SELECT c_custkey, concat_ws('|', c_name, 'x "q"', lower(c_mktsegment)) AS leaves FROM customer""")
def _(spark, sf):
    c = table(spark, sf, "customer")
    text = F.concat(F.lit('{"a": "'), "c_name", F.lit('", "n": 5, "b": ["x \\"q\\"", {"c": "'), F.lower("c_mktsegment"), F.lit('"}], "t": true}'))
    return c.select("c_custkey", joined(tm.json_strings(text), "leaves"))


@query("d13_evidence_sources", f"""SELECT card_id, CASE WHEN has THEN 'ss_tag_frequency|ss_dataset_dirs|model card|README|modelspec' ELSE 'model card|README' END AS sources
  FROM (SELECT c.*, l.unit IS NOT NULL AS has FROM ({_CARD}) c LEFT JOIN (SELECT DISTINCT l_suppkey AS unit FROM lineitem) l ON l.unit = c.unit)""")
def _(spark, sf):
    c = carded(spark, sf)
    return c.select("card_id", joined(tm.evidence_sources(F.col("metadata"), F.col("card"), F.col("readme")), "sources"))


@query("d14_prompt_resolution", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 AND user_id % 2 = 0 THEN 'sks ' || user_id ELSE '' END AS text,
  CASE WHEN event_id % 3 = 0 THEN 'user' WHEN event_id % 3 = 1 AND user_id % 2 = 0 THEN 'trigger' ELSE 'unconditional' END AS source FROM events""")
def _(spark, sf):
    e = table(spark, sf, "events")
    user = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).when(F.col("event_id") % 3 == 1, "")
    words = F.when((F.col("event_id") % 3 == 1) & (F.col("user_id") % 2 == 0), F.array(F.concat(F.lit("sks "), F.col("user_id").cast("string")))).otherwise(F.array().cast("array<string>"))
    out = e.select("event_id", tm.resolve_prompt(user, words).alias("p"))
    return out.select("event_id", "p.text", "p.source")
