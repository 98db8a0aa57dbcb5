"""Queries on reshaped article frames, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.functions.dates import utc_date
from pressmill.operators import frames
from pressmill.sources.tables import table

_Q: dict = {}
_SQL: dict[str, str] = {}

_ART = "(SELECT DISTINCT ON (art_id) * FROM articles ORDER BY art_id)"
_FLAT = f"""one AS (SELECT art_id, u.i - 1 AS sent_pos, u.s.sentence AS top_sent, u.s.entities AS ents FROM {_ART} a
      LEFT JOIN LATERAL (SELECT unnest(a.ner_coref) AS s, generate_subscripts(a.ner_coref, 1) AS i) u ON true),
    flat AS (SELECT art_id, sent_pos, v.j - 1 AS ent_pos, top_sent, v.e.comp_name AS comp_name, v.e.comp_symbol AS comp_symbol, v.e.ent_text AS ent_text, v.e.set_in AS set_in
      FROM one LEFT JOIN LATERAL (SELECT unnest(one.ents) AS e, generate_subscripts(one.ents, 1) AS j) v ON true)"""


def _register(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _articles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "articles").dropDuplicates(["art_id"])


@_register(f"WITH {_FLAT} SELECT art_id, CAST(sent_pos AS INTEGER) AS sent_pos, CAST(ent_pos AS INTEGER) AS ent_pos, top_sent, comp_name, comp_symbol FROM flat")
def x1_x2_explode_mentions(spark, d):
    return frames.flatten_mentions(_articles(spark, d)).select("art_id", "sent_pos", "ent_pos", "top_sent", "comp_name", "comp_symbol")


@_register(f"WITH {_FLAT} SELECT top_sent, comp_symbol, comp_name, CAST(arg_max(art_id, (art_id, sent_pos, ent_pos)) AS BIGINT) AS art_id FROM flat GROUP BY top_sent, comp_symbol, comp_name")
def a3_keep_last(spark, d):
    flat = frames.flatten_mentions(_articles(spark, d)).select("top_sent", "comp_symbol", "comp_name", "art_id", "sent_pos", "ent_pos")
    return frames.keep_last(flat, ["top_sent", "comp_symbol", "comp_name"], ["art_id", "sent_pos", "ent_pos"]).select("top_sent", "comp_symbol", "comp_name", "art_id")




@_register(f"""WITH {_FLAT}, kept AS (SELECT top_sent, comp_symbol, comp_name, arg_max(art_id, (art_id, sent_pos, ent_pos)) AS art_id FROM flat GROUP BY top_sent, comp_symbol, comp_name),
  k AS (SELECT *, split_part(comp_symbol, '.', 1) AS comp_symbol_raw, split_part(comp_symbol, '.', 2) AS comp_symbol_country FROM kept WHERE top_sent IS NOT NULL AND comp_symbol IS NOT NULL AND comp_name IS NOT NULL)
  SELECT k.art_id, k.top_sent, k.comp_symbol, k.comp_name, k.comp_symbol_raw, k.comp_symbol_country, coalesce(i.isin, 'isin_not_found') AS comp_isin FROM k LEFT JOIN symbol_isin i ON i.symbol = k.comp_symbol_raw""")
def j1_kg_rows_with_isin(spark, d):
    return frames.kg_rows(table(spark, d, "articles"), table(spark, d, "symbol_isin")).select("art_id", "top_sent", "comp_symbol", "comp_name", "comp_symbol_raw", "comp_symbol_country", "comp_isin")


@_register("""WITH s AS (SELECT DISTINCT comp_symbol, split_part(comp_symbol, '.', 1) AS raw FROM mentions WHERE comp_symbol IS NOT NULL)
  SELECT s.raw AS comp_symbol_raw, count(DISTINCT i.isin) AS isins, count(DISTINCT s.comp_symbol) AS symbols FROM s JOIN symbol_isin i ON i.symbol = s.raw GROUP BY s.raw HAVING count(DISTINCT i.isin) > 1 OR count(DISTINCT s.comp_symbol) > 1""")
def j1_ambiguous_tickers(spark, d):
    s = frames.split_symbol(table(spark, d, "mentions").where("comp_symbol IS NOT NULL").select("comp_symbol").distinct())
    i = table(spark, d, "symbol_isin").select(F.col("symbol").alias("comp_symbol_raw"), "isin")
    return s.join(i, "comp_symbol_raw").groupBy("comp_symbol_raw").agg(F.countDistinct("isin").alias("isins"), F.countDistinct("comp_symbol").alias("symbols")).where("isins > 1 OR symbols > 1")


@_register("SELECT sent_id, CAST(row_number() OVER (ORDER BY art_id, sent_pos, sent_id) - 1 AS BIGINT) AS dense_id FROM sentences WHERE sent_text IS NOT NULL")
def sel_p3_dense_row_ids(spark, d):
    s = table(spark, d, "sentences").where("sent_text IS NOT NULL").select("sent_id", "art_id", "sent_pos")
    return frames.dense_ids(s, "dense_id", ["art_id", "sent_pos", "sent_id"]).select("sent_id", "dense_id")


@_register("SELECT mention_id, art_id, sent_id, comp_symbol FROM mentions WHERE comp_symbol IS NOT NULL AND comp_name IS NOT NULL AND set_in IS NOT NULL")
def sel_p5_dropna_subset(spark, d):
    return table(spark, d, "mentions").dropna(subset=["comp_symbol", "comp_name", "set_in"]).select("mention_id", "art_id", "sent_id", "comp_symbol")


@_register("SELECT symbol, isin FROM symbol_isin WHERE symbol IS NOT NULL AND isin IS NOT NULL")
def sel_p6_dropna_all(spark, d):
    return table(spark, d, "symbol_isin").dropna()


@_register("SELECT node_id, coalesce(comp_isin, 'isin_not_found') AS comp_isin FROM company_nodes")
def sel_p7_fillna(spark, d):
    return table(spark, d, "company_nodes").na.fill({"comp_isin": "isin_not_found"}).select("node_id", "comp_isin")


@_register("SELECT s.sent_id, t.top_id, t.top_description FROM sentences s JOIN topics t ON s.top_id = t.top_id")
def sel_p4_topic_lookup(spark, d):
    return table(spark, d, "sentences").select("sent_id", "top_id").join(table(spark, d, "topics"), "top_id").select("sent_id", "top_id", "top_description")


@_register("SELECT mention_id, label FROM mentions WHERE label IN ('OWN-REGEX', 'ORG-PART') AND coalesce(set_in, '') <> ''")
def sel_p9_label_predicate(spark, d):
    return table(spark, d, "mentions").where(F.col("label").isin("OWN-REGEX", "ORG-PART") & (F.coalesce("set_in", F.lit("")) != "")).select("mention_id", "label")


@_register("SELECT DISTINCT m.comp_symbol FROM mentions m WHERE m.comp_symbol IS NOT NULL AND NOT EXISTS (SELECT 1 FROM company_nodes n WHERE n.comp_symbol = m.comp_symbol)")
def sel_p10_anti_join(spark, d):
    m = table(spark, d, "mentions").where("comp_symbol IS NOT NULL").select("comp_symbol").distinct()
    return m.join(table(spark, d, "company_nodes").select("comp_symbol"), "comp_symbol", "left_anti")


@_register("SELECT art_id, art_title FROM (SELECT DISTINCT art_id, art_title FROM articles) WHERE regexp_matches(art_title, '(?i)rating|analyse')")
def sel_p12_title_contains(spark, d):
    return table(spark, d, "articles").where(F.col("art_title").rlike("(?i)rating|analyse")).select("art_id", "art_title").distinct()


@_register("SELECT art_id, CASE WHEN lower(art_language) LIKE 'de%' OR lower(art_language) = 'german' THEN 'german' WHEN lower(art_language) LIKE 'en%' THEN 'english' ELSE 'other' END AS pipeline FROM (SELECT DISTINCT art_id, art_language FROM articles)")
def sel_p13_language_dispatch(spark, d):
    low = F.lower("art_language")
    branch = F.when(low.startswith("de") | (low == "german"), "german").when(low.startswith("en"), "english").otherwise("other")
    return table(spark, d, "articles").select("art_id", "art_language").distinct().select("art_id", branch.alias("pipeline"))


@_register("SELECT CAST(floor((row_number() OVER (ORDER BY sent_id) - 1) / 30) AS BIGINT) AS chunk, sent_id FROM sentences")
def sel_p18_chunks_of_rows(spark, d):
    s = frames.dense_ids(table(spark, d, "sentences").select("sent_id"), "n", ["sent_id"])
    return s.select(F.floor(F.col("n") / 30).alias("chunk"), "sent_id")


@_register("SELECT doc_id, u.pos AS pos, substring(text, u.pos * 500 + 1, 500) AS piece FROM documents, LATERAL (SELECT unnest(range(0, CAST(ceil(length(text) / 500.0) AS BIGINT))) AS pos) u WHERE length(text) > 0")
def sel_p19_fixed_width_pieces(spark, d):
    t = table(spark, d, "documents").where("length(text) > 0")
    n = F.ceil(F.length("text") / 500).cast("bigint")
    return t.select("doc_id", "text", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("pos")).select("doc_id", "pos", F.col("text").substr((F.col("pos") * 500 + 1).cast("int"), F.lit(500)).alias("piece"))


@_register("SELECT doc_id, p AS par FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\.\\s*\\n')) AS p FROM documents WHERE text IS NOT NULL) WHERE p <> ''")
def x6_paragraph_split(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(F.split("text", r"\.\s*\n")).alias("par")).where("par <> ''")


@_register("SELECT art_id, array_to_string(flatten(list_transform(ner_coref, lambda s: list_transform(coalesce(s.entities, []), lambda e: e.comp_symbol))), ',') AS symbols FROM (SELECT DISTINCT ON (art_id) art_id, ner_coref FROM articles ORDER BY art_id) WHERE ner_coref IS NOT NULL")
def x3_flatten_lists(spark, d):
    a = _articles(spark, d).where("ner_coref IS NOT NULL")
    inner = F.transform("ner_coref", lambda s: F.coalesce(F.transform(s["entities"], lambda e: e["comp_symbol"]), F.array().cast("array<string>")))
    return a.select("art_id", F.array_join(F.flatten(inner), ",").alias("symbols"))


@_register("SELECT top_id, round(avg(sent_pos), 6) AS mean_pos, count(*) AS n, count(DISTINCT art_id) AS articles FROM sentences WHERE top_id IS NOT NULL AND sent_text IS NOT NULL GROUP BY top_id")
def a1_cluster_aggregate(spark, d):
    """Means and sizes of each topic; its texts, which grow with the data, are those of ``a1_cluster_texts``."""
    s = table(spark, d, "sentences").where("top_id IS NOT NULL AND sent_text IS NOT NULL")
    return s.groupBy("top_id").agg(F.round(F.avg("sent_pos"), 6).alias("mean_pos"), F.count("*").alias("n"), F.countDistinct("art_id").alias("articles"))


@_register("""SELECT top_id, art_id, round(avg(sent_pos), 6) AS mean_pos, count(*) AS n, string_agg(sent_text, ' ' ORDER BY sent_pos, sent_id) AS joined FROM sentences WHERE top_id IS NOT NULL AND sent_text IS NOT NULL AND art_id IS NOT NULL GROUP BY top_id, art_id""")
def a1_cluster_texts(spark, d):
    """The joined text of each topic, an article at a time, so that no group grows with the data."""
    s = table(spark, d, "sentences").where("top_id IS NOT NULL AND sent_text IS NOT NULL AND art_id IS NOT NULL")
    return s.groupBy("top_id", "art_id").agg(F.round(F.avg("sent_pos"), 6).alias("mean_pos"), F.count("*").alias("n"), frames.ordered_join(F.col("sent_text"), F.struct("sent_pos", "sent_id"), " ").alias("joined"))


_WORDS = """w AS (SELECT top_id, sent_id, unnest(regexp_extract_all(lower(sent_text), '[a-zäöüß]{3,}')) AS word FROM sentences WHERE top_id IS NOT NULL AND sent_text IS NOT NULL)"""


@_register(f"""WITH {_WORDS}, c AS (SELECT top_id, word, count(*) AS n FROM w GROUP BY top_id, word)
  SELECT top_id, word, n FROM c QUALIFY row_number() OVER (PARTITION BY top_id ORDER BY n DESC, word) <= 5""")
def a2_top_words(spark, d):
    s = table(spark, d, "sentences").where("top_id IS NOT NULL")
    c = s.select("top_id", F.explode(F.regexp_extract_all(F.lower("sent_text"), F.lit("[a-zäöüß]{3,}"), F.lit(0))).alias("word")).groupBy("top_id", "word").agg(F.count("*").alias("n"))
    return frames.top_n(c, ["top_id"], [F.desc("n"), F.asc("word")], 5)


@_register("SELECT DISTINCT comp_name FROM mentions WHERE comp_name IS NOT NULL")
def a4_distinct_names(spark, d):
    return table(spark, d, "mentions").where("comp_name IS NOT NULL").select("comp_name").distinct()


@_register("SELECT art_id, comp_name, comp_symbol, start_char FROM (SELECT DISTINCT * FROM mentions) WHERE comp_symbol IS NOT NULL QUALIFY row_number() OVER (PARTITION BY art_id, comp_name, comp_symbol ORDER BY start_char, mention_id) = 1")
def a5_first_mention(spark, d):
    m = table(spark, d, "mentions").where("comp_symbol IS NOT NULL").select("art_id", "comp_name", "comp_symbol", "start_char", "mention_id")
    return frames.keep_first(m, ["art_id", "comp_name", "comp_symbol"], ["start_char", "mention_id"]).select("art_id", "comp_name", "comp_symbol", "start_char")


@_register("SELECT m.comp_symbol, string_agg(DISTINCT s.top_id, ',' ORDER BY s.top_id) AS topics FROM mentions m JOIN sentences s ON s.sent_id = m.sent_id WHERE m.comp_symbol IS NOT NULL AND s.top_id IS NOT NULL GROUP BY m.comp_symbol")
def a8_collect_by_key(spark, d):
    """The topics of each company; a list has at most as many entries as there are topics."""
    m = table(spark, d, "mentions").where("comp_symbol IS NOT NULL").select("comp_symbol", "sent_id")
    s = table(spark, d, "sentences").where("top_id IS NOT NULL").select("sent_id", "top_id")
    return m.join(s, "sent_id").groupBy("comp_symbol").agg(F.array_join(F.sort_array(F.collect_set("top_id")), ",").alias("topics"))


@_register("SELECT comp_symbol, count(*) AS n FROM mentions GROUP BY comp_symbol")
def a10_value_counts(spark, d):
    return table(spark, d, "mentions").groupBy("comp_symbol").agg(F.count("*").alias("n"))


@_register("SELECT count(DISTINCT comp_symbol) AS symbols, count(DISTINCT art_id) AS articles FROM mentions")
def a11_unique_counts(spark, d):
    return table(spark, d, "mentions").agg(F.countDistinct("comp_symbol").alias("symbols"), F.countDistinct("art_id").alias("articles"))


@_register("""WITH c AS (SELECT art_id, comp_symbol, count(*) AS n, min(mention_id) AS pos FROM mentions WHERE comp_symbol IS NOT NULL GROUP BY art_id, comp_symbol)
  SELECT art_id, comp_symbol, n FROM c QUALIFY row_number() OVER (PARTITION BY art_id ORDER BY n DESC, pos) = 1""")
def a12_main_company(spark, d):
    return frames.most_frequent(table(spark, d, "mentions").where("comp_symbol IS NOT NULL"), ["art_id"], "comp_symbol", "mention_id")


@_register("SELECT CAST(extract(year FROM published_at AT TIME ZONE 'UTC') AS INTEGER) AS year, round(avg(n_chars), 4) AS mean_chars FROM documents WHERE published_at IS NOT NULL GROUP BY 1")
def a13_mean_by_year(spark, d):
    return table(spark, d, "documents").where("published_at IS NOT NULL").groupBy(F.year(utc_date(F.col("published_at"))).alias("year")).agg(F.round(F.avg("n_chars"), 4).alias("mean_chars"))


@_register("""WITH s AS (SELECT CAST(date_trunc('month', a.art_datetime AT TIME ZONE 'UTC') AS DATE) AS month, s.top_id FROM sentences s JOIN (SELECT DISTINCT art_id, art_datetime FROM articles WHERE art_datetime IS NOT NULL) a USING (art_id) WHERE s.top_id IS NOT NULL),
  c AS (SELECT month, top_id, count(*) AS n FROM s GROUP BY month, top_id)
  SELECT month, top_id, round(100.0 * n / sum(n) OVER (PARTITION BY month), 4) AS share FROM c""")
def a14_topic_share(spark, d):
    a = table(spark, d, "articles").where("art_datetime IS NOT NULL").select("art_id", F.trunc(utc_date(F.col("art_datetime")), "month").alias("month")).distinct()
    c = table(spark, d, "sentences").where("top_id IS NOT NULL").select("art_id", "top_id").join(a, "art_id").groupBy("month", "top_id").agg(F.count("*").alias("n"))
    total = c.groupBy("month").agg(F.sum("n").alias("total"))
    return c.join(total, "month").select("month", "top_id", F.round(F.lit(100.0) * F.col("n") / F.col("total"), 4).alias("share"))


@_register(f"WITH {_WORDS} SELECT word, count(*) AS n FROM w GROUP BY word ORDER BY n DESC, word LIMIT 20")
def a15_global_terms(spark, d):
    s = table(spark, d, "sentences").where("top_id IS NOT NULL")
    return s.select(F.explode(F.regexp_extract_all(F.lower("sent_text"), F.lit("[a-zäöüß]{3,}"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(20)


@_register("SELECT top_id, count(*) AS size, max(sent_pos) AS longest FROM sentences GROUP BY top_id")
def a16_a17_cluster_size(spark, d):
    return table(spark, d, "sentences").groupBy("top_id").agg(F.count("*").alias("size"), F.max("sent_pos").alias("longest"))


@_register("SELECT symbol, name FROM companies ORDER BY name, symbol LIMIT 25")
def o1_o3_sorted_head(spark, d):
    return table(spark, d, "companies").select("symbol", "name").orderBy(F.asc_nulls_last("name"), "symbol").limit(25)


@_register("SELECT art_id, string_agg(concat_ws(':', start_char, end_char, coalesce(comp_symbol, '-')), ' ' ORDER BY start_char, end_char DESC, comp_symbol NULLS FIRST, mention_id) AS spans FROM (SELECT DISTINCT * FROM mentions) GROUP BY art_id")
def o2_sorted_spans(spark, d):
    m = table(spark, d, "mentions").select("mention_id", "art_id", "start_char", "end_char", "comp_symbol").distinct()
    spans = F.sort_array(F.collect_list(F.struct("start_char", (-F.col("end_char")).alias("m"), "comp_symbol", "mention_id", "end_char")))
    return m.groupBy("art_id").agg(F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["start_char"].cast("string"), x["end_char"].cast("string"), F.coalesce(x["comp_symbol"], F.lit("-")))), " ").alias("spans"))


@_register("SELECT comp_name AS name FROM mentions UNION ALL SELECT name FROM companies")
def u1_bag_union(spark, d):
    return table(spark, d, "mentions").select(F.col("comp_name").alias("name")).unionByName(table(spark, d, "companies").select("name"))


@_register("SELECT comp_symbol AS symbol FROM mentions UNION SELECT symbol FROM companies")
def u2_set_union(spark, d):
    return table(spark, d, "mentions").select(F.col("comp_symbol").alias("symbol")).union(table(spark, d, "companies").select("symbol")).distinct()


@_register("SELECT symbol FROM companies EXCEPT SELECT comp_symbol FROM mentions")
def u4_set_difference(spark, d):
    return table(spark, d, "companies").select("symbol").subtract(table(spark, d, "mentions").select("comp_symbol"))


@_register("SELECT a.art_id, a.art_title FROM (VALUES (1), (3), (3), (7), (12)) AS x(i) JOIN (SELECT DISTINCT art_id, art_title FROM articles) a ON a.art_id = x.i")
def s24_rows_by_index(spark, d):
    wanted = spark.createDataFrame([(1,), (3,), (3,), (7,), (12,)], "art_id bigint")
    return wanted.join(table(spark, d, "articles").select("art_id", "art_title").distinct(), "art_id")


@_register("SELECT art_id, len(ner_coref) AS sentences, ner_coref[1].sentence AS first_sentence FROM (SELECT DISTINCT ON (art_id) art_id, ner_coref FROM articles ORDER BY art_id) WHERE len(ner_coref) > 0")
def sel_p1_struct_fields(spark, d):
    a = _articles(spark, d).where("size(ner_coref) > 0")
    return a.select("art_id", F.size("ner_coref").cast("bigint").alias("sentences"), F.try_element_at("ner_coref", F.lit(1))["sentence"].alias("first_sentence"))


@_register("SELECT sent_id, art_id FROM sentences WHERE NOT (sent_text IS NULL) AND top_id IS NOT NULL")
def sel_p11_not_null(spark, d):
    return table(spark, d, "sentences").where(F.col("sent_text").isNotNull() & F.col("top_id").isNotNull()).select("sent_id", "art_id")


@_register("SELECT symbol AS comp_symbol_raw, isin AS comp_isin FROM symbol_isin")
def sel_p15_rename(spark, d):
    return table(spark, d, "symbol_isin").withColumnsRenamed({"symbol": "comp_symbol_raw", "isin": "comp_isin"})


@_register("SELECT node_id, CASE WHEN comp_symbol IS NOT NULL THEN 'symbol' WHEN comp_isin IS NOT NULL AND comp_isin <> 'isin_not_found' THEN 'isin' ELSE 'name' END AS known_by FROM company_nodes")
def sel_p17_conditional(spark, d):
    known = F.when(F.col("comp_symbol").isNotNull(), "symbol").when(F.col("comp_isin").isNotNull() & (F.col("comp_isin") != "isin_not_found"), "isin").otherwise("name")
    return table(spark, d, "company_nodes").select("node_id", known.alias("known_by"))


@_register("SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS x, round(CAST(embedding[2] AS DOUBLE), 6) AS y, round(CAST(embedding[3] AS DOUBLE), 6) AS z FROM embeddings WHERE len(embedding) >= 3")
def x4_vector_columns(spark, d):
    e = table(spark, d, "embeddings").where("size(embedding) >= 3")
    return e.select("vec_id", *[F.round(F.col("embedding")[i].cast("double"), 6).alias(c) for i, c in enumerate("xyz")])


@_register("SELECT symbol, split_part(symbol, '.', 1) AS comp_symbol_raw, split_part(symbol, '.', 2) AS comp_symbol_country FROM companies")
def x5_split_columns(spark, d):
    return frames.split_symbol(table(spark, d, "companies"), "symbol").select("symbol", "comp_symbol_raw", "comp_symbol_country")


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
