import numpy as np

from pressmill.operators import spans, topics


def test_nmf_is_that_of_the_whole_matrix(spark):
    v = np.random.default_rng(2).random((5, 7)) * (np.random.default_rng(3).random((5, 7)) > 0.4)
    v[:, 0] += 0.1
    v[0] += 0.1
    rows = [(f"d{i}", f"t{j}", float(v[i, j])) for i in range(5) for j in range(7) if v[i, j] > 0]
    df = spark.createDataFrame(rows, "id string, term string, w double")
    dense = lambda f, key: np.array([r["factors"] for r in f.orderBy(key).collect()])
    (w0, h0), (w, h) = ([dense(f, k) for f, k in zip(topics.nmf(df, 2, steps=n), ("id", "term"))] for n in (0, 2))
    for _ in range(2):
        h0 = h0 * (v.T @ w0) / (h0 @ (w0.T @ w0) + 1e-12)
        w0 = w0 * (v @ h0) / (w0 @ (h0.T @ h0) + 1e-12)
    assert np.allclose(w, w0) and np.allclose(h, h0)
    assert np.linalg.norm(v - w @ h.T) < np.linalg.norm(v)


def test_models_are_saved_and_applied_to_new_rows(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i % 3), float(i // 3)]) for i in range(30)], "id bigint, x array<double>")
    model, _ = topics.kmeans(df, "x", 3)
    topics.save_model(model, str(tmp_path / "k"))
    new = spark.createDataFrame([(1, [0.0, 1.0]), (2, None)], "id bigint, x array<double>")
    got = {r["id"]: r["cluster_label"] for r in topics.apply_model(topics.load_model(spark, str(tmp_path / "k")), new, "x").collect()}
    assert got[2] is None and got[1] == {r["id"]: r["cluster_label"] for r in topics.apply_model(model, new, "x").collect()}[1]
    reducer, _ = topics.pca(df, "x", 1)
    topics.save_model(reducer, str(tmp_path / "p"))
    rows = topics.apply_model(topics.load_model(spark, str(tmp_path / "p")), new, "x").collect()
    assert sum(r["_p"] is None for r in rows) == 1 and len(rows) == 2


def test_sizes_of_topic_models(spark):
    docs = spark.createDataFrame([(["a", "b"] if i % 2 else ["c", "d"],) for i in range(20)], "words array<string>")
    counts = topics.bag_of_words(spark, list("abcd"), "words", "v").transform(docs)
    sizes = topics.lda_by_size(counts, "v", (2, 3), steps=3)
    assert [k for k, _, _ in sizes] == [2, 3] and all(np.isfinite(x) and y > 0 for _, x, y in sizes)


def test_rows_are_read_once_for_all_sizes(spark):
    """One table of vectors serves all models, spread over the tasks; perplexity is the bound by the words."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    docs = spark.createDataFrame([(["a", "b", "b"] if i % 2 else ["c", "d"],) for i in range(20)], "words array<string>").coalesce(1).mapInArrow(seen, "words array<string>")
    counts = topics.bag_of_words(spark, list("abcd"), "words", "v").transform(docs)
    sizes = topics.lda_by_size(counts, "v", (2, 3), steps=3)
    assert read.value == 20
    assert all(np.isclose(y, -x / 50) for _, x, y in sizes)
    model = topics.lda(counts, "v", 2, steps=3)
    assert np.isclose(model.logPerplexity(counts), -model.logLikelihood(counts) / 50)


def test_partial_ratio():
    assert spans.partial_ratio("saldor", "die saldor ag") == 100.0 == spans.partial_ratio("", "")
    assert spans.partial_ratio("", "a") == 0.0 and spans.partial_ratio("abcd", "xxabxx") == max(spans.indel_ratio("abcd", p) for p in ("x", "xx", "xxa", "xxab", "xabx", "abxx", "bxx"))
