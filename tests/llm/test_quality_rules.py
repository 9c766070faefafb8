import zlib

import numpy as np
from pyspark.sql import functions as F

from recollect.llm.quality_rules import Rule, RuleEnsemble, _lasso, fit_rules, fold, score_quality, statistics, train

DATA = "/root/testdata/sf0.01"


def test_rules_find_a_conjunction():
    rng = np.random.default_rng(0)
    values = {"a": rng.random(3000), "b": rng.random(3000), "c": rng.random(3000)}
    y = ((values["a"] > 0.5) & (values["b"] <= 0.3)).astype(int)
    model = fit_rules(values, y)
    assert ((model.logits(values) > 0).astype(int) == y).mean() > 0.97
    assert len(model.rules) < 120


def test_one_label_or_none():
    assert fit_rules({"a": np.ones(5)}, np.ones(5)).rules == ()
    assert fit_rules({"a": np.zeros(0)}, np.zeros(0)).bias == 0


def test_column_equals_numpy(spark):
    texts = ["", None, "Some words, here.", "LOUD!! LOUD!! LOUD!!", "a | b | c\nx", "é" * 50_000, "#$% *** 12"]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    model = RuleEnsemble(-0.5, (Rule((("upper", True, 0.2), ("words", False, 10.0)), 2.0), Rule((("symbols", True, 0.1),), -1.0)))
    got = [r.score for r in score_quality(df, model).orderBy("doc_id").collect()]
    stats = df.orderBy("doc_id").select(*[c.alias(n) for n, c in statistics(F.col("text")).items()]).toPandas()
    want = 1 / (1 + np.exp(-model.logits({n: stats[n].to_numpy() for n in stats})))
    assert np.allclose(got, want)
    assert stats["words"].tolist() == [0, 0, 3, 3, 6, 1, 3]
    assert score_quality(df.limit(0), model).count() == 0


def test_lasso_reaches_the_optimum():
    """The optimality conditions of the lasso, and no better point on a grid around the weights."""
    rng = np.random.default_rng(3)
    z = (rng.random((400, 6)) < 0.4).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * z[:, 0] - 1.5 * z[:, 1] - 0.3)))).astype(float)
    penalty = 0.02
    bias, w = _lasso(z, y, penalty, steps=3000)
    error = 1 / (1 + np.exp(-(bias + z @ w))) - y
    slope = z.T @ error / len(y)
    assert abs(error.mean()) < 1e-5 and (w == 0).any() and (w[:2] != 0).all()
    assert np.allclose(slope[w != 0], -penalty * np.sign(w[w != 0]), atol=1e-5) and (np.abs(slope[w == 0]) <= penalty + 1e-5).all()

    def loss(b, v):
        m = b + z @ v
        return np.mean(np.log1p(np.exp(-np.abs(m))) + np.maximum(m, 0) - y * m) + penalty * np.abs(v).sum()

    best = loss(bias, w)
    assert all(loss(bias + rng.normal(0, s), w + rng.normal(0, s, 6)) > best for s in (0.01, 0.1, 1) for _ in range(200))


def test_repeated_ids_and_clashing_names(spark):
    rows = [(i, f"good words number {i}." if i % 2 else f"BAD!!! {i} ###") for i in range(60)]
    docs = spark.createDataFrame(rows + [(1, "zzz"), (2, None)] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 0), (None, 1), (3, None)], "doc_id long, quality int")
    models = [train(d, labels) for d in (docs, docs.orderBy(F.desc("text")), docs.where("text is not null and text <> 'zzz'"))]
    assert models[0] == models[1] == models[2] and models[0].rules
    some = docs.limit(5).select("*", F.lit(7).alias("_stat_words"), F.lit(8).alias("__stat_x"))
    got = score_quality(some, models[0])
    assert got.columns == [*some.columns, "score"] and got.select("_stat_words", "__stat_x").distinct().collect() == [(7, 8)]
    assert train(docs.limit(0), labels).rules == () and train(docs, labels.limit(0)).rules == ()


def test_fold_and_held_out_accuracy(spark):
    assert spark.range(1).select(fold(F.lit(77), 3)).first()[0] == zlib.crc32(b"77") % 3
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels)
    rows = score_quality(docs, model).join(labels, "doc_id").where(fold(F.col("doc_id"), 3) == 1).select("score", "quality").toPandas()
    right = (rows.score >= 0.5) == (rows.quality == 1)
    assert right.mean() > 0.95 > max(rows.quality.mean(), 1 - rows.quality.mean()) and right[rows.quality == 1].mean() > 0.95 and right[rows.quality == 0].mean() > 0.8
