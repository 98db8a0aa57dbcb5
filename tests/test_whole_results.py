"""Queries that once did less than the whole job, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressmill.operators import spans, topics
from pressmill.plans import graph_queries, topic_queries


def vectors(spark, path, x, labels=None):
    rows = [(i, (labels or [0] * len(x))[i], [float(v) for v in x[i]]) for i in range(len(x))]
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")


def test_percent_rank_of_every_feature(spark, tmp_path):
    x = np.random.default_rng(1).integers(0, 9, (30, 7)).astype(float)
    vectors(spark, tmp_path, x)
    got = {(r["vec_id"], r["k"]): r["v"] for r in topic_queries.v7_percent_rank(spark, str(tmp_path)).collect()}
    assert got == {(i, k): pytest.approx((x[:, k] < x[i, k]).sum() / 29, abs=1e-6) for i in range(30) for k in range(7)}


def test_cosine_pairs_with_smaller_ids_and_other_labels(spark, tmp_path):
    x = np.random.default_rng(2).normal(size=(70, 6))
    vectors(spark, tmp_path, x, [i % 3 for i in range(70)])
    u = x.astype(np.float32).astype(float)
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    like = u @ u.T
    expected = {(a, b): pytest.approx(like[a, b], abs=1e-5) for a in range(0, 70, 20) for b in range(70) if a != b and like[a, b] > 0.3 and not (b % 20 == 0 and b < a)}
    got = graph_queries.g19_cosine_pairs(spark, str(tmp_path)).collect()
    assert len(got) == len(expected) and {(r["a"], r["b"]): r["likeness"] for r in got} == expected
    assert any(b < a for a, b in expected) and any(a % 3 != b % 3 for a, b in expected)


def test_mean_shift_uses_every_row(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 0.1, (1100, 2)), rng.normal(0, 0.1, (3, 2)) + 30])
    ids = [r["id"] for r in spark.range(len(x)).orderBy(F.xxhash64("id"), "id").collect()]  # the small cluster has the greatest hashes
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in zip(ids, x)], "id bigint, x array<double>").repartition(3)
    found = {r["id"]: r["cluster_label"] for r in topics.mean_shift(df, "id", "x").collect()}
    label = [found[i] for i in ids]
    centres = topics.mean_shift_centres(x)
    assert label == ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1).tolist()
    assert len(set(label[1100:])) == 1 and label[1100] not in label[:1100]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert topics.mean_shift_width(df) == pytest.approx(np.sort(d, axis=1)[:, 219].mean(), rel=1e-6)


def test_fuzzy_with_and_without_legal_form(spark):
    v = spark.createDataFrame([("Nalfalvervik",), ("Zeldorova Chemie",), ("Bolta SE",), ("Bolta AG",), ("Kurz",)], "comp_name string")
    n = spark.createDataFrame([("N", "Nalfalvervik GmbH & Co. KG"), ("Z", "Zeldorova Chemie GmbH & Co. KG"), ("B1", "Bolta AG"), ("B2", "Bolta SE"), ("L", "Langer GmbH")], "symbol string, name string")
    got = {r["value"]: (r["key"], r["ratio"]) for r in spans.fuzzy_best(v, n, "comp_name", "symbol", "name").collect()}
    assert got == {"Nalfalvervik": ("N", 100.0), "Zeldorova Chemie": ("Z", 100.0), "Bolta SE": ("B2", 100.0), "Bolta AG": ("B1", 100.0)}


def test_like_terms_are_sought_among_all(spark, tmp_path):
    common = " ".join(f"wort{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(70))
    rows = [(1, f"{common} {common} xylo xenon"), (2, f"{common} zebra"), (3, f"{common} zebra zinn"), (4, "zinn xylo aal aar")]
    spark.createDataFrame([(i, t, f"t{i}") for i, t in rows], "sent_id bigint, sent_text string, top_id string").write.parquet(f"{tmp_path}/sentences.parquet")
    words = sorted({w for _, t in rows for w in t.split()})
    x = np.array([[t.split().count(w) for _, t in rows] for w in words], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pairs = [(words[i], words[j], round(float(x[i] @ x[j]), 6)) for i in range(len(words)) for j in range(i) if x[i] @ x[j] > 0]
    expected = sorted(pairs, key=lambda p: (-p[2], p[0], p[1]))
    for n, block in ((40, 7), (40, 2000), (5000, 7)):
        weights = spark.createDataFrame([(w, str(k), float(x[i, k])) for i, w in enumerate(words) for k in range(4) if x[i, k]], "term string, id string, w double")
        assert [tuple(r) for r in topics.likest_terms(weights, n, block=block).collect()] == expected[:n]
    assert [tuple(r) for r in topic_queries.j16_term_likeness(spark, str(tmp_path)).collect()] == expected[:40]
