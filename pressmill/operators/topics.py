"""Topics: words, weights, vectors, reductions, clusters."""

from __future__ import annotations

import math
from collections.abc import Iterable
from itertools import islice

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import LDA, KMeans, KMeansModel
from pyspark.ml.feature import PCA, CountVectorizerModel, MinMaxScaler, Normalizer, RobustScaler, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that carry no topic (fixed values), of the two main languages.
STOP_WORDS = tuple(
    """der die das den dem des ein eine einen einem einer und oder aber als auch auf aus bei bis für hat ist mit nach nicht sein sich sie sind
    von vor war was wie wird zum zur the a an and or but as at by for from has have is it its of on that this to was will with""".split()
)


def topic_words(text: Column, stop: Iterable[str] = STOP_WORDS) -> Column:
    """Lower-case words of at least two letters without stop words; null where none is left."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-zäöüß]{2,}"), F.lit(0))
    kept = F.filter(found, lambda w: ~w.isin(*stop))
    return F.when(F.size(kept) > 0, kept)


def term_counts(docs: DataFrame, id_col: str, words_col: str) -> DataFrame:
    """(id, term, n) of each document; the long form of a bag of words."""
    return docs.select(F.col(id_col).alias("id"), F.explode(words_col).alias("term")).groupBy("id", "term").agg(F.count("*").alias("n"))


def l2_weights(counts: DataFrame, value: str = "n") -> DataFrame:
    """(id, term, w): weights of each document scaled to length 1."""
    length = counts.groupBy("id").agg(F.sqrt(F.sum(F.col(value).cast("double") * F.col(value))).alias("_len"))
    return counts.join(length, "id").select("id", "term", (F.col(value) / F.col("_len")).alias("w"))


def tf_idf(counts: DataFrame, docs: int) -> DataFrame:
    """(id, term, w): count times ln((1 + docs) / (1 + df)) + 1, scaled to length 1."""
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    raw = counts.join(df, "term").select("id", "term", (F.col("n") * (F.log((1 + F.lit(docs)) / (1 + F.col("df"))) + 1)).alias("v"))
    return l2_weights(raw, "v")


def likest_terms(weights: DataFrame, n: int, block: int = 2000, piece: int = 1000) -> DataFrame:
    """(term, other, likeness): the ``n`` pairs of terms most like over all terms, term > other; ties in their order.

    Weights are (term, id, w) of length 1 for each term. A term is a dense vector over the ids, so these must be few (topics);
    blocks of terms go to the executors, each task keeps its own best ``n``.
    """
    import pyarrow as pa

    from pressmill.operators.frames import dense_ids
    from pressmill.plans.arrow import map_batches
    from pressmill.plans.lineage import cut

    spark = weights.sparkSession
    at = {r["id"]: i for i, r in enumerate(weights.select("id").distinct().orderBy("id").collect())}
    terms = cut(dense_ids(weights.groupBy("term").agg(F.collect_list("id").alias("ids"), F.collect_list("w").alias("ws")), "idx", ["term"]).select("idx", "term", "ids", "ws"))

    def dense(ids: list, ws: list) -> np.ndarray:
        x = np.zeros((len(ids), len(at)))
        for i, (k, w) in enumerate(zip(ids, ws)):
            x[i, [at[j] for j in k]] = w
        return x

    out, rows = None, terms.toLocalIterator()
    while part := sorted(islice(rows, block)):
        shared = spark.sparkContext.broadcast((np.array([r["idx"] for r in part]), [r["term"] for r in part], dense([r["ids"] for r in part], [r["ws"] for r in part])))

        def make(shared=shared):
            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                other, names, y = shared.value
                found = []
                for start in range(0, batch.num_rows, piece):
                    idx, term, ids, ws = (c.to_pylist() for c in batch.slice(start, piece).columns)
                    order = np.argsort(idx)
                    raw = dense(ids, ws)[order] @ y.T
                    like = np.where((raw > 0) & (np.array(idx)[order][:, None] > other[None]), np.round(raw, 6), -1.0).ravel()
                    last = np.partition(like, len(like) - n)[len(like) - n] if len(like) > n else -1.0
                    above = np.flatnonzero(like > last)
                    best = np.concatenate([above, np.flatnonzero(like == last)[: n - len(above)]]) if len(like) > n else above
                    found += [(term[order[i // len(other)]], names[i % len(other)], float(like[i])) for i in best if like[i] >= 0]
                return pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.string()), pa.array([r[1] for r in found], pa.string()), pa.array([r[2] for r in found], pa.float64())], ["term", "other", "likeness"])

            return step

        best = map_batches(terms, make, "term string, other string, likeness double")
        out = best if out is None else out.unionByName(best)
    if out is None:
        return spark.createDataFrame([], "term string, other string, likeness double")
    return out.orderBy(F.desc("likeness"), "term", "other").limit(n)


def vocabulary(docs: DataFrame, words_col: str, min_docs: int = 1) -> list[str]:
    """Sorted words of at least ``min_docs`` documents, for a fixed vocabulary on the driver."""
    rows = docs.select(F.explode(F.array_distinct(words_col)).alias("term")).groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_docs)
    return [r["term"] for r in rows.orderBy("term").toLocalIterator()]


def bag_of_words(spark, words: list[str], input_col: str, output_col: str, binary: bool = False) -> CountVectorizerModel:
    model = CountVectorizerModel.from_vocabulary(sorted(words), inputCol=input_col, outputCol=output_col)
    return model.setBinary(binary)


def scaled(df: DataFrame, column: str, kind: str) -> DataFrame:
    """``column``, an array, scaled feature by feature: minmax, standard, robust or l2; a model that sees all rows."""
    df = df.withColumn("_v", array_to_vector(column))
    scaler = {
        "minmax": MinMaxScaler(inputCol="_v", outputCol="_s"),
        "standard": StandardScaler(inputCol="_v", outputCol="_s", withMean=True, withStd=True),
        "robust": RobustScaler(inputCol="_v", outputCol="_s", withCentering=True),
    }.get(kind)
    out = scaler.fit(df).transform(df) if scaler else Normalizer(inputCol="_v", outputCol="_s", p=2.0).transform(df)
    return out.withColumn(column, vector_to_array("_s")).drop("_v", "_s")


def quantile_scaled(df: DataFrame, id_col: str, column: str) -> DataFrame:
    """(id, values): each feature as its place among 100 quantiles of all rows, between them in proportion.

    The quantile grid is one aggregate of fixed size.
    """
    grid = np.linspace(0, 1, 101).tolist()
    long = df.select(F.col(id_col).alias("id"), F.posexplode(column).alias("k", "x"))
    marks = long.groupBy("k").agg(F.percentile_approx("x", grid, 100_000).alias("q"))
    at = lambda q, x: F.size(F.filter(q, lambda m: m <= x))
    placed = long.join(marks, "k").withColumn("i", at(F.col("q"), F.col("x")))
    low, high = F.element_at("q", F.greatest(F.col("i"), F.lit(1))), F.element_at("q", F.least(F.col("i") + 1, F.lit(101)))
    share = F.when(high > low, (F.col("x") - low) / (high - low)).otherwise(0.0)
    value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("i") - 1 + share) / 100))
    return placed.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", value.alias("v")))), lambda s: s["v"]).alias("values"))


def pca(df: DataFrame, column: str, k: int) -> tuple[PipelineModel, DataFrame]:
    """Centred, then projected on k components; the sign of a component is free."""
    df = df.withColumn("_v", array_to_vector(column))
    model = Pipeline(stages=[StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False), PCA(k=k, inputCol="_c", outputCol="_p")]).fit(df)
    return model, model.transform(df).withColumn("reduced", vector_to_array("_p")).drop("_v", "_c", "_p")


def truncated_svd(df: DataFrame, column: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right vectors; the matrix stays distributed."""
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import RowMatrix

    svd = RowMatrix(df.select(column).rdd.map(lambda r: Vectors.dense(r[0]))).computeSVD(k)
    return np.array(svd.s.toArray()), svd.V.toArray()


def gram_matrix(df: DataFrame, column: str) -> np.ndarray:
    """Sum of the outer products of all rows: one partial sum a partition, of the size of the features squared."""
    import pyarrow as pa

    def partial(batches):
        total = None
        for b in batches:
            if b.num_rows:
                x = np.array(b.column(0).to_pylist(), float)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([r.tolist() for r in total])], ["i", "row"])

    long = df.select(column).mapInArrow(partial, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    cells = long.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    n = 1 + max((r["i"] for r in cells), default=-1)
    out = np.zeros((n, n))
    for r in cells:
        out[r["i"], r["j"]] = r["v"]
    return out


def kernel_pca(df: DataFrame, id_col: str, column: str, k: int, landmarks: int = 500) -> DataFrame:
    """(id, reduced): cosine-kernel components. The kernel is linear in unit vectors, so its components are those of their covariance."""
    from pressmill.functions.vectors import unit

    u = df.select(F.col(id_col).alias("id"), unit(F.col(column)).alias("u"))
    n = u.count()
    mean = np.array([r["m"] for r in u.select(F.posexplode("u").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("m")).orderBy("k").collect()])
    cov = gram_matrix(u, "u") - n * np.outer(mean, mean)
    values, vectors = np.linalg.eigh(cov)
    top = vectors[:, np.argsort(values)[::-1][:k]]
    parts = [F.aggregate(F.zip_with("u", F.array(*[F.lit(float(x)) for x in top[:, j]]), lambda a, b: a * b), F.lit(float(-(mean @ top[:, j]))), lambda s, x: s + x) for j in range(top.shape[1])]
    return u.select("id", F.array(*parts).alias("reduced"))


def nmf(weights: DataFrame, topics: int, steps: int = 20, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(id, factors) and (term, factors): non-negative factors of the whole (id, term, w) matrix, its zeros included.

    Multiplicative updates of the squared error; only the cells above 0 are joined, what the zeros weigh is in
    the products of the factors with themselves, of the size of the topics squared. Starts from a hash of ids and
    terms, so that each run gives the same. Both factors are cut to the shared folder after every step.
    """
    from pressmill.plans.lineage import cut

    names = [f"_f{j}" for j in range(topics)]

    def start(key: str, salt: int) -> DataFrame:
        value = lambda j: 0.1 + F.pmod(F.xxhash64(key, F.lit(seed + salt + j)), F.lit(1000)) / 1000.0
        return cut(weights.select(key).distinct().select(key, *[value(j).alias(n) for j, n in enumerate(names)]))

    def step(mine: DataFrame, other: DataFrame, key: str, by: str) -> DataFrame:
        square = other.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}{b}") for a in names for b in names]).first()
        upper = weights.join(other, by).groupBy(key).agg(*[F.sum(F.col("w") * F.col(n)).alias(f"u{n}") for n in names])
        lower = lambda n: sum((F.col(m) * float(square[f"{m}{n}"] or 0.0) for m in names), F.lit(1e-12))
        return cut(mine.join(upper, key).select(key, *[(F.col(n) * F.col(f"u{n}") / lower(n)).alias(n) for n in names]))

    left, right = start("id", 0), start("term", topics)
    for _ in range(steps):
        right = step(right, left, "term", "id")
        left = step(left, right, "id", "term")
    packed = lambda df, key: df.select(key, F.array(*names).alias("factors"))
    return packed(left, "id"), packed(right, "term")


def save_model(model, folder: str) -> None:
    """A fitted model or pipeline, written over what is there."""
    model.write().overwrite().save(folder)


def load_model(spark, folder: str):
    """The model that ``save_model`` wrote, of whatever class."""
    from pyspark.ml.util import DefaultParamsReader

    return DefaultParamsReader.loadParamsInstance(folder, spark)


def apply_model(model, df: DataFrame, column: str, vector_col: str = "_v") -> DataFrame:
    """New rows through a fitted model that reads ``vector_col``; rows with a null in ``column`` come out with nulls."""
    made = model.transform(df.where(F.col(column).isNotNull()).withColumn(vector_col, array_to_vector(column))).drop(vector_col)
    return made.unionByName(df.where(F.col(column).isNull()), allowMissingColumns=True)


def lda_by_size(counts_vector: DataFrame, column: str, sizes: Iterable[int], seed: int = 7, steps: int = 20) -> list[tuple[int, float, float]]:
    """(topics, log likelihood, log perplexity) of a model of each size, over all rows.

    The vectors are made once and dealt to all tasks, a small table would be one of them else. The bound on the
    likelihood is an inference over all rows; perplexity is the same bound by the words counted, so one is enough.
    """
    from pressmill.plans.lineage import cut_table

    spark = counts_vector.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = cut_table(counts_vector.select(column).repartition(tasks))
    total = counts.select(Summarizer.sum(F.col(column)).alias("words")).first()["words"]
    words = float(total.toArray().sum())
    out = []
    for k in sizes:
        likelihood = lda(counts, column, k, seed, steps).logLikelihood(counts)
        out.append((k, likelihood, -likelihood / words))
    return out


def coherence(docs: DataFrame, words_col: str, top_words: DataFrame, id_col: str = "id") -> DataFrame:
    """(topic, coherence) of ``top_words`` (topic, rank, word): the sum of ln((documents with both words + 1) / documents with the higher ranked one)."""
    held = docs.select(F.col(id_col).alias("_id"), F.explode(F.array_distinct(words_col)).alias("word")).join(top_words.select("word").distinct(), "word")
    single = held.groupBy("word").agg(F.count("*").alias("df"))
    pairs = held.join(held.withColumnRenamed("word", "other"), "_id").where("word <> other").groupBy("word", "other").agg(F.count("*").alias("both"))
    hi, lo = top_words.select("topic", "word", F.col("rank").alias("hi")), top_words.select("topic", F.col("word").alias("other"), F.col("rank").alias("lo"))
    scored = hi.join(lo, "topic").where("hi < lo").join(single, "word").join(pairs, ["word", "other"], "left")
    return scored.groupBy("topic").agg(F.sum(F.log((F.coalesce("both", F.lit(0)) + 1) / F.col("df"))).alias("coherence"))


def lda(counts_vector: DataFrame, column: str, k: int, seed: int = 7, steps: int = 20):
    return LDA(k=k, maxIter=steps, seed=seed, featuresCol=column).fit(counts_vector)


def kmeans(df: DataFrame, column: str, k: int, seeds: Iterable[int] = (1, 2, 3)) -> tuple[KMeansModel, DataFrame]:
    """The best of several starts, by the cost of the fit."""
    df = df.withColumn("_v", array_to_vector(column))
    models = [KMeans(k=k, seed=s, maxIter=50, featuresCol="_v", predictionCol="cluster_label").fit(df) for s in seeds]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best, best.transform(df).drop("_v")


def mean_shift_centres(sample: np.ndarray, quantile: float = 0.2, floor: float = 0.001, steps: int = 100) -> np.ndarray:
    """Centres of a bounded sample by flat-kernel mean shift; the bandwidth is the mean distance to the given share of neighbours."""
    if not len(sample):
        return sample
    d = np.sqrt(np.maximum(0, ((sample[:, None] - sample[None]) ** 2).sum(-1)))
    width = max(floor, float(np.sort(d, axis=1)[:, max(0, int(len(sample) * quantile) - 1)].mean()))
    points = sample.copy()
    for _ in range(steps):
        near = ((points[:, None] - sample[None]) ** 2).sum(-1) <= width**2
        new = near @ sample / np.maximum(1, near.sum(1, keepdims=True))
        if np.abs(new - points).max() < 1e-6 * width:
            break
        points = new
    support = (((points[:, None] - sample[None]) ** 2).sum(-1) <= width**2).sum(1)
    centres: list[np.ndarray] = []
    for i in sorted(range(len(points)), key=lambda i: (-support[i], *points[i])):
        if all(((points[i] - c) ** 2).sum() > width**2 for c in centres):
            centres.append(points[i])
    return np.array(centres)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, feature by feature: exact where points are equal, and of the size of the result."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        out += (a[:, j, None] - b[None, :, j]) ** 2
    return out


def _over_rows(rows: DataFrame, points: np.ndarray, radii: np.ndarray | None, width: float = 0.0, piece: int = 1000) -> np.ndarray:
    """For each point, over all rows: the number within each of its radii or, without radii, the sum and the number within ``width``."""
    import pyarrow as pa

    shared = rows.sparkSession.sparkContext.broadcast((points, radii))

    def partial(batches):
        points, radii = shared.value
        total = np.zeros((len(points), points.shape[1] + 1 if radii is None else radii.shape[1]))
        for batch in batches:
            for at in range(0, batch.num_rows, piece):
                x = np.array(batch.column(0).slice(at, piece).to_pylist(), float)
                d = _squares(points, x)
                if radii is None:
                    near = (d <= width**2).astype(float)
                    total += np.column_stack([near @ x, near.sum(1)])
                else:
                    d = np.sort(np.sqrt(d), axis=1)
                    total += np.array([np.searchsorted(d[i], radii[i], side="right") for i in range(len(points))])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(points)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "part"])

    parts = rows.select("x").mapInArrow(partial, "i int, part array<double>")
    out = np.zeros((len(points), points.shape[1] + 1 if radii is None else radii.shape[1]))
    for r in parts.toLocalIterator():
        out[r["i"]] += r["part"]
    shared.unpersist()
    return out


def mean_shift_width(rows: DataFrame, quantile: float = 0.2, floor: float = 0.001, block: int = 1000, marks: int = 64, passes: int = 5) -> float:
    """The mean over all rows of the distance to the given share of all rows; each distance is narrowed down by counts within radii."""
    n = rows.count()
    k = max(1, int(n * quantile))
    box = rows.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg((F.max("v") - F.min("v")).alias("w")).collect()
    far = math.sqrt(sum(r["w"] ** 2 for r in box)) * (1 + 1e-9)
    total = 0.0
    for points in _blocks(rows, block):
        low, high = np.full(len(points), -far * 1e-12), np.full(len(points), far)
        for _ in range(passes):
            radii = low[:, None] + (high - low)[:, None] * np.arange(1, marks + 1) / marks
            radii[:, -1] = high
            first = (_over_rows(rows, points, radii) >= k).argmax(1)
            each = np.arange(len(points))
            low, high = np.where(first > 0, radii[each, first - 1], low), radii[each, first]
        total += float(high.sum())
    return max(floor, total / n)


def _blocks(rows: DataFrame, block: int):
    it = rows.select("x").toLocalIterator()
    while part := [r["x"] for r in islice(it, block)]:
        yield np.array(part, float)


def mean_shift(df: DataFrame, id_col: str, column: str, quantile: float = 0.2, floor: float = 0.001, steps: int = 100, block: int = 1000) -> DataFrame:
    """(id, cluster_label): flat-kernel mean shift over all rows, as ``mean_shift_centres``; every row goes to its nearest centre.

    Every row is a start; blocks of starts are sent to the executors, and each step sums the
    rows within the bandwidth in Spark. Starts that met go on as one. The work grows with the
    square of the rows.
    """
    every = df.select(F.col(id_col).alias("id"), F.col(column).cast("array<double>").alias("x"))
    rows = every.where("x IS NOT NULL")
    if rows.isEmpty():
        return every.select("id", F.lit(-1).alias("cluster_label"))
    width = mean_shift_width(rows, quantile, floor, block)
    ends: dict[tuple, tuple[float, np.ndarray]] = {}
    for points in _blocks(rows, block):
        for step in range(steps + 1):
            points = points[np.unique(np.round(points / (1e-9 * width)), axis=0, return_index=True)[1]]
            found = _over_rows(rows, points, None, width)
            support = found[:, -1]
            new = found[:, :-1] / np.maximum(1, support)[:, None]
            if step == steps or np.abs(new - points).max() < 1e-6 * width:
                break
            points = new
        for p, s in zip(points, support):
            ends[tuple(np.round(p / (1e-6 * width)))] = (s, p)
    centres: list[np.ndarray] = []
    for _, p in sorted(ends.values(), key=lambda e: (-e[0], *e[1])):
        if all(((p - c) ** 2).sum() > width**2 for c in centres):
            centres.append(p)
    far = lambda c: F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    distances = F.array(*[far(c) for c in centres])
    return every.select("id", (F.array_position(distances, F.array_min(distances)) - 1).cast("int").alias("cluster_label"))
