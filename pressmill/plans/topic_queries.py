"""Queries on topics and vectors, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pressmill.functions.vectors import dot
from pressmill.operators import topics
from pressmill.operators.frames import top_n
from pressmill.plans.lineage import cut
from pressmill.sources.tables import table

_Q: dict = {}
_SQL: dict[str, str] = {}

_STOP = "(" + ", ".join(f"'{w}'" for w in topics.STOP_WORDS) + ")"
_W = f"""w AS (SELECT top_id, sent_id, unnest(regexp_extract_all(lower(sent_text), '[a-zäöüß]{{2,}}')) AS term FROM sentences WHERE top_id IS NOT NULL),
  c AS (SELECT top_id AS id, term, count(*) AS n FROM w WHERE term NOT IN {_STOP} GROUP BY top_id, term)"""
_L2 = "l AS (SELECT id, term, n / sqrt(sum(CAST(n AS DOUBLE) * n) OVER (PARTITION BY id)) AS w FROM c)"


def _register(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _counts(spark, d):
    s = table(spark, d, "sentences").where("top_id IS NOT NULL").select("top_id", topics.topic_words(F.col("sent_text")).alias("words"))
    return cut(topics.term_counts(s.where("words IS NOT NULL"), "top_id", "words"))  # counted once, however often it is read


@_register(f"SELECT sent_id, len(list_filter(regexp_extract_all(lower(sent_text), '[a-zäöüß]{{2,}}'), lambda w: w NOT IN {_STOP})) AS kept FROM sentences WHERE len(list_filter(regexp_extract_all(lower(sent_text), '[a-zäöüß]{{2,}}'), lambda w: w NOT IN {_STOP})) > 0")
def r32_token_filter(spark, d):
    s = table(spark, d, "sentences").select("sent_id", topics.topic_words(F.col("sent_text")).alias("w"))
    return s.where("w IS NOT NULL").select("sent_id", F.size("w").cast("bigint").alias("kept"))


@_register(f"WITH {_W} SELECT DISTINCT term, CAST(dense_rank() OVER (ORDER BY term) - 1 AS BIGINT) AS idx FROM c")
def v1_vocabulary(spark, d):
    from pressmill.operators.frames import dense_ids

    terms = _counts(spark, d).select("term").distinct()
    return dense_ids(terms, "idx", ["term"]).select("term", "idx")


@_register(f"WITH {_W} SELECT id, term, n FROM c")
def v2_bag_of_words(spark, d):
    return _counts(spark, d)


@_register(f"WITH {_W}, {_L2} SELECT id, term, round(w, 8) AS w FROM l")
def v3_l2_term_weights(spark, d):
    return topics.l2_weights(_counts(spark, d)).select("id", "term", F.round("w", 8).alias("w"))


@_register(f"WITH {_W} SELECT id, term, 1 AS present FROM c")
def v4_one_hot(spark, d):
    return _counts(spark, d).select("id", "term", F.lit(1).alias("present"))


@_register(f"""WITH {_W}, df AS (SELECT term, count(*) AS df FROM c GROUP BY term), m AS (SELECT count(DISTINCT id) AS docs FROM c),
  r AS (SELECT c.id, c.term, c.n * (ln((1.0 + m.docs) / (1 + df.df)) + 1) AS v FROM c JOIN df USING (term), m)
  SELECT id, term, round(v / sqrt(sum(v * v) OVER (PARTITION BY id)), 8) AS w FROM r""")
def v24_tf_idf(spark, d):
    counts = _counts(spark, d)
    return topics.tf_idf(counts, counts.select("id").distinct().count()).select("id", "term", F.round("w", 8).alias("w"))


@_register(f"WITH {_W}, df AS (SELECT term, count(*) AS df FROM c GROUP BY term), m AS (SELECT count(DISTINCT id) AS docs FROM c) SELECT term, df FROM df, m WHERE df >= 2 AND df <= 0.8 * m.docs")
def v23_document_frequency(spark, d):
    counts = _counts(spark, d)
    docs = counts.select("id").distinct().count()
    return counts.groupBy("term").agg(F.count("*").alias("df")).where((F.col("df") >= 2) & (F.col("df") <= 0.8 * docs))


@_register(f"WITH {_W}, {_L2} SELECT a.id, b.id AS other, round(sum(a.w * b.w), 6) AS likeness FROM l a JOIN l b ON a.term = b.term AND a.id < b.id GROUP BY a.id, b.id")
def v22_topic_likeness(spark, d):
    w = topics.l2_weights(_counts(spark, d))
    o = w.select(F.col("id").alias("other"), "term", F.col("w").alias("v"))
    return w.join(o, "term").where("id < other").groupBy("id", "other").agg(F.round(F.sum(F.col("w") * F.col("v")), 6).alias("likeness"))


@_register(f"WITH {_W}, {_L2} SELECT id, term, round(w, 8) AS w FROM l QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(w, 8) DESC, term) <= 10")
def v21_topic_table(spark, d):
    w = topics.l2_weights(_counts(spark, d)).select("id", "term", F.round("w", 8).alias("w"))
    return top_n(w, ["id"], [F.desc("w"), F.asc("term")], 10)


@_register(f"WITH {_W}, t AS (SELECT id, sum(n) AS total FROM c GROUP BY id) SELECT id, term, round(100.0 * n / total, 6) AS share FROM c JOIN t USING (id) QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, term) <= 5")
def v25_top_word_shares(spark, d):
    c = _counts(spark, d)
    total = c.groupBy("id").agg(F.sum("n").alias("total"))
    return top_n(c, ["id"], [F.desc("n"), F.asc("term")], 5).join(total, "id").select("id", "term", F.round(F.lit(100.0) * F.col("n") / F.col("total"), 6).alias("share"))


@_register(f"""WITH {_W}, k AS (SELECT id, term, n / sqrt(sum(CAST(n AS DOUBLE) * n) OVER (PARTITION BY term)) AS w FROM c)
  SELECT a.term, b.term AS other, round(sum(a.w * b.w), 6) AS likeness FROM k a JOIN k b ON a.id = b.id AND a.term > b.term GROUP BY a.term, b.term ORDER BY 3 DESC, 1, 2 LIMIT 40""")
def j16_term_likeness(spark, d):
    k = topics.l2_weights(_counts(spark, d).select(F.col("term").alias("id"), F.col("id").alias("term"), "n"))
    return topics.likest_terms(k.select(F.col("id").alias("term"), F.col("term").alias("id"), "w"), 40)


@_register("""WITH s AS (SELECT sent_id, list_distinct(regexp_extract_all(lower(sent_text), '[a-zäöüß]{4,}')) AS w FROM sentences WHERE sent_text IS NOT NULL), q AS (SELECT w AS qw FROM s ORDER BY sent_id LIMIT 1)
  SELECT sent_id, len(list_intersect(w, qw)) AS shared FROM s, q WHERE len(list_intersect(w, qw)) > 0""")
def v28_one_hot_dot(spark, d):
    s = table(spark, d, "sentences").where("sent_text IS NOT NULL").select("sent_id", F.array_distinct(F.regexp_extract_all(F.lower("sent_text"), F.lit("[a-zäöüß]{4,}"), F.lit(0))).alias("w"))
    q = s.orderBy("sent_id").limit(1).select(F.col("w").alias("qw"))
    return s.join(F.broadcast(q)).select("sent_id", F.size(F.array_intersect("w", "qw")).cast("bigint").alias("shared")).where("shared > 0")


def _long(spark, d, kind):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return topics.scaled(e, "x", kind).select("vec_id", F.posexplode("x").alias("k", "v")).select("vec_id", "k", F.round("v", 6).alias("v"))


_E = "e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings)"


@_register(f"WITH {_E}, m AS (SELECT k, min(v) AS a, max(v) AS b FROM e GROUP BY k) SELECT vec_id, CAST(k AS INTEGER) AS k, round((v - a) / (b - a), 6) AS v FROM e JOIN m USING (k)")
def v8_min_max_scaled(spark, d):
    return _long(spark, d, "minmax")


@_register(f"WITH {_E}, m AS (SELECT k, avg(v) AS a, stddev_samp(v) AS s FROM e GROUP BY k) SELECT vec_id, CAST(k AS INTEGER) AS k, round((v - a) / s, 6) AS v FROM e JOIN m USING (k)")
def v27_standard_scaled(spark, d):
    return _long(spark, d, "standard")


@_register()
def v27_robust_scaled(spark, d):
    return _long(spark, d, "robust")


@_register(f"WITH {_E} SELECT vec_id, CAST(k AS INTEGER) AS k, round(v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)), 6) AS v FROM e")
def v3_l2_scaled_vectors(spark, d):
    return _long(spark, d, "l2")


@_register(f"WITH {_E} SELECT vec_id, CAST(k AS INTEGER) AS k, round(percent_rank() OVER (PARTITION BY k ORDER BY v), 6) AS v FROM e")
def v7_percent_rank(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "v")).select("vec_id", "k", F.col("v").cast("double").alias("v"))
    return e.select("vec_id", "k", F.round(F.percent_rank().over(Window.partitionBy("k").orderBy("v")), 6).alias("v"))


@_register()
def v7_quantile_scaled(spark, d):
    return topics.quantile_scaled(table(spark, d, "embeddings"), "vec_id", "embedding")


@_register()
def v9_pca(spark, d):
    return topics.pca(table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x")), "x", 3)[1].select("vec_id", "reduced")


@_register()
def v10_kernel_pca(spark, d):
    return topics.kernel_pca(table(spark, d, "embeddings"), "vec_id", "embedding", 3).select(F.col("id").alias("vec_id"), "reduced")


@_register()
def v11_singular_values(spark, d):
    values, _ = topics.truncated_svd(table(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("x")), "x", 5)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, value double")


@_register()
def v14_nmf(spark, d):
    _, terms = topics.nmf(topics.l2_weights(_counts(spark, d)), 5, steps=5)
    return terms.select("term", F.posexplode("factors").alias("topic", "w"))


@_register(f"""WITH {_W}, l2 AS (SELECT id, term, n / sqrt(sum(CAST(n AS DOUBLE) * n) OVER (PARTITION BY id)) AS w FROM c), t AS (SELECT id AS topic, term AS word, row_number() OVER (PARTITION BY id ORDER BY round(w, 8) DESC, term) AS rank FROM l2 QUALIFY rank <= 5),
  s AS (SELECT sent_id, list_distinct(list_filter(regexp_extract_all(lower(sent_text), '[a-zäöüß]{{2,}}'), lambda w: w NOT IN {_STOP})) AS ws FROM sentences WHERE sent_text IS NOT NULL),
  h AS (SELECT DISTINCT sent_id, word FROM (SELECT sent_id, unnest(ws) AS word FROM s) WHERE word IN (SELECT word FROM t)), f AS (SELECT word, count(*) AS df FROM h GROUP BY word),
  p AS (SELECT a.word, b.word AS other, count(*) AS n FROM h a JOIN h b ON a.sent_id = b.sent_id AND a.word <> b.word GROUP BY ALL)
  SELECT x.topic, round(sum(ln((coalesce(p.n, 0) + 1.0) / f.df)), 6) AS coherence FROM t x JOIN t y ON x.topic = y.topic AND x.rank < y.rank JOIN f ON f.word = x.word LEFT JOIN p ON p.word = x.word AND p.other = y.word GROUP BY x.topic""")
def v26_coherence(spark, d):
    w = topics.l2_weights(_counts(spark, d)).select("id", "term", F.round("w", 8).alias("w"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("w"), "term"))
    top = w.withColumn("rank", rank).where("rank <= 5").select(F.col("id").alias("topic"), "rank", F.col("term").alias("word"))
    docs = table(spark, d, "sentences").select("sent_id", topics.topic_words(F.col("sent_text")).alias("words")).where("words IS NOT NULL")
    return topics.coherence(docs, "words", top, "sent_id").select("topic", F.round("coherence", 6).alias("coherence"))


@_register()
def v26_perplexity(spark, d):
    docs = table(spark, d, "sentences").select("sent_id", topics.topic_words(F.col("sent_text")).alias("words")).where("words IS NOT NULL")
    counts = topics.bag_of_words(spark, topics.vocabulary(docs, "words", 20), "words", "v").transform(docs)
    return spark.createDataFrame(topics.lda_by_size(counts, "v", (3, 5), steps=5), "topics int, log_likelihood double, log_perplexity double")


@_register()
def v15_lda(spark, d):
    docs = table(spark, d, "sentences").select("sent_id", topics.topic_words(F.col("sent_text")).alias("words")).where("words IS NOT NULL")
    model = topics.lda(topics.bag_of_words(spark, topics.vocabulary(docs, "words", 20), "words", "v").transform(docs), "v", 5, steps=10)
    return model.describeTopics(8).select("topic", "termIndices", "termWeights")


@_register()
def v17_kmeans(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return topics.kmeans(e, "x", 10)[1].select("vec_id", "cluster_label")


@_register()
def v18_mean_shift(spark, d):
    return topics.mean_shift(table(spark, d, "embeddings"), "vec_id", "embedding").select(F.col("id").alias("vec_id"), "cluster_label")


@_register(f"WITH {_E} SELECT vec_id, round(sum(v * v), 6) AS sq FROM e GROUP BY vec_id")
def v6_squared_norms(spark, d):
    x = F.col("embedding")
    return table(spark, d, "embeddings").where("embedding IS NOT NULL").select("vec_id", F.round(dot(x, x), 6).alias("sq"))


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
