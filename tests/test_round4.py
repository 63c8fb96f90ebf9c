"""Findings of round 4: training with many small batches, all strategies at once, the energy score's
pairs."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from wavemark.functions import energy
from wavemark.operators import selection, thresholds
from wavemark.plans import neural


def made_rows(spark, n):
    return spark.range(n).select(F.col("id").alias("seq"), F.array(F.array(F.col("id") / n), F.array(F.sin("id"))).alias("window"), F.array(F.array(F.cos("id"))).alias("target"), (F.col("id") % 2).alias("regime_label"))


JOINT = neural.ModelConfig(1, hidden=3, components=2, n_regimes=2)


def test_joint_training_by_turns_equals_a_plain_loop(spark, monkeypatch):
    """Runs of batches that tasks take one after another: the weights of one process, step by step,
    and a step is no exchange (F1: 150 exchanges take 150 seconds)."""
    rows, training = made_rows(spark, 150), neural.TrainingConfig(epochs=1, batch_size=1, rate=0.03, supervised=0.2, seed=4)
    order = rows.orderBy(F.xxhash64("seq", F.lit(4), F.lit(0))).toPandas()
    state, losses = neural.Adam.first(neural.initial(JOINT, 4)), []
    for a in range(150):
        part = order.iloc[a : a + 1]
        loss, g = neural.loss_and_gradient(JOINT, state.weights, *neural._arrays(part), part["regime_label"].to_numpy(), 0.2)
        losses.append(loss)
        state.take(g, 1, training)
    for steps in (256, 60):  # one task; three, the last with fewer steps
        monkeypatch.setattr(neural, "TURN_STEPS", steps)
        start = time.time()
        model = neural.train(rows, JOINT, training)
        assert time.time() - start < 75
        assert model.train_loss == pytest.approx([np.mean(losses)], rel=1e-9)
        assert all(np.allclose(model.weights[k], state.weights[k], atol=1e-9) for k in state.weights)


def test_mixture_training_does_not_follow_the_turns(spark, monkeypatch):
    """with dropout too, the model is the same for any number of turns; forecasts keep all rows and
    columns of any type."""
    rows, config = made_rows(spark, 130).withColumn("name", F.concat(F.lit("s"), F.col("seq"))), neural.ModelConfig(1, hidden=3, components=2, layers=2, dropout=0.3)
    models = []
    for steps in (256, 20):  # one task; four
        monkeypatch.setattr(neural, "TURN_STEPS", steps)
        start = time.time()
        models.append(neural.train(rows, config, neural.TrainingConfig(epochs=1, batch_size=2)))
        assert time.time() - start < 40  # 65 exchanges took 65 seconds
    assert models[0].train_loss == models[1].train_loss and all(np.array_equal(models[0].weights[k], models[1].weights[k]) for k in models[0].weights)
    got = neural.predict(rows, models[0], ("name", "seq")).orderBy("seq").collect()
    want = neural.forward(config, models[0].weights, *neural._arrays(rows.orderBy("seq").toPandas())[:1])
    assert [(r["name"], r["h"]) for r in got] == [(f"s{i}", 0) for i in range(130)]
    assert np.allclose([r["means"] for r in got], want["means"][:, 0]) and np.allclose([r["stds"] for r in got], want["stds"][:, 0]) and all(r["probs"] == [] for r in got)
    with pytest.raises(Exception, match="one shape"):
        ragged = F.when(F.col("seq") == 3, F.slice("window", 1, 1)).otherwise(F.col("window"))
        neural.predict(rows.withColumn("window", ragged).coalesce(1), models[0]).collect()


def counted_jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def validation(spark, n, positive):
    rng = np.random.default_rng(5)
    scores, labels = np.round(rng.gamma(2.0, 2.0, n), 1), (rng.random(n) < 0.1).astype(int) * positive  # scores with ties
    return spark.createDataFrame([(i, float(scores[i]), int(labels[i]), i * 5 // n) for i in range(n)], "seq long, score double, label int, group_id int").cache()


def test_all_strategies_at_once_equal_each_alone(spark):
    """the same thresholds and measures, in as many jobs for all as for one of each kind."""
    rows, kinds = validation(spark, 400, True), ["max_validation_f1", "validation_quantile_95", "per_machine_validation_quantile_985", "target_recall_50"]
    _, few = counted_jobs(spark, "kinds", lambda: selection.select_thresholds(rows, kinds))
    found, many = counted_jobs(spark, "all", lambda: selection.select_thresholds(rows))
    assert list(found) == list(thresholds.STRATEGIES) and many <= few + 2
    for s in kinds:
        c, alone = found[s], selection.select_threshold(rows, s)
        assert c.threshold == alone.threshold and c.metrics == {k: pytest.approx(v) for k, v in alone.metrics.items()}
        if c.by_group:
            a, b = (dict(x.by_group.collect()) for x in (c, alone))
            assert a == b and len(a) == 5


def test_the_query_finds_all_strategies_at_once(spark, monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(selection, "select_threshold", None)
    assert entry.queries()["select_threshold_strategies"](spark, "/root/testdata/sf0.001").count() == 17


def test_strategies_without_positives_and_with_bad_scores(spark):
    rows = validation(spark, 100, False)
    found = selection.select_thresholds(rows, ["target_recall_70", "validation_quantile_95", "target_recall_50"])
    assert [c.threshold for c in found.values()] == pytest.approx(np.quantile([r["score"] for r in rows.collect()], [0.9, 0.95, 0.95]).tolist())
    assert all(c.metrics["recall"] == 0 for c in found.values())
    for bad in (float("nan"), float("inf"), None):
        with pytest.raises(Exception, match="finite"):
            selection.select_thresholds(rows.withColumn("score", F.when(F.col("seq") != 7, F.col("score")).otherwise(F.lit(bad).cast("double"))), ["validation_quantile_95"])
    with pytest.raises(ValueError, match="strategy"):
        selection.select_thresholds(rows, ["guess"])


@pytest.mark.parametrize("d", [1, 2, 3])
def test_energy_pairs(d):
    """each pair of samples once, and exactly: samples far from 0 lost the digits of short gaps."""
    rng = np.random.default_rng(2)
    y, w, m, s, keys = rng.normal(size=(70, d)) + 1e6, rng.random((70, 3)), rng.normal(size=(70, 3, d)) + 1e6, 0.1 + rng.random((70, 3, d)), np.arange(70)
    got, share = energy.scores(y, w, m, s, keys, 33, 5), np.cumsum(w / w.sum(axis=1, keepdims=True), axis=1)
    for r in range(70):
        part = [min(int((share[r] <= u).sum()), 2) for u in energy.uniforms(keys[r : r + 1], 5, 33)[0]]
        x = m[r, part] + s[r, part] * energy.normals(keys[r : r + 1], 6, 33 * d).reshape(33, d)
        want = np.linalg.norm(x - y[r], axis=1).mean() - np.linalg.norm(x[:, None] - x[None], axis=2).mean() / 2
        assert got[r] == pytest.approx(want, abs=1e-9)
        assert got[r] == energy.scores(y[r : r + 1], w[r : r + 1], m[r : r + 1], s[r : r + 1], keys[r : r + 1], 33, 5)[0]  # whatever it is held with


def test_the_energy_query_uses_all_cores(spark):
    import __spark_entry__ as entry

    assert entry.queries()["energy_score"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 16
