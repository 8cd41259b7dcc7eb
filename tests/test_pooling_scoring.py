"""Pooling and scores against plain Python on literal and random votes."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywise.operators import agreement, lengths, pooling, prepare, scoring
from tallywise.plans import benchmark

VOTES = "row_id int, run_idx int, label int, pred int"


def random_votes(rows=300, runs=10, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(rows):
        label = rng.choice([None, 0, 1, 2, 3, 4, 5, 6])
        out += [(i, r, label, rng.choice([-1, 0, 1, 2, 3, 9])) for r in range(runs)]
    return out


def by_row(votes):
    rows = {}
    for i, r, label, pred in sorted(votes, key=lambda v: (v[0], v[1])):
        rows.setdefault(i, (label, []))[1].append(pred)
    return rows


def test_majority_keeps_first_seen_on_ties(spark):
    votes = random_votes()
    df = spark.createDataFrame(votes, VOTES).repartition(7)
    for k in (1, 2, 3, 4, 5, 10, 99):
        expected = {i: Counter(p[:k]).most_common(1)[0][0] for i, (_, p) in by_row(votes).items()}
        got = {r.row_id: r.pred for r in pooling.pool(df, "majority", k).collect()}
        assert got == expected


def test_tie_is_not_the_smallest_value(spark):
    df = spark.createDataFrame([(1, 0, 2, 2), (1, 1, 2, 1), (1, 2, 2, 2), (1, 3, 2, 1)], VOTES)
    assert pooling.pool(df, "majority").first().pred == 2


def test_copies_of_a_vote_pool_to_it(spark):
    df = spark.createDataFrame([(i, r, None, i % 7) for i in range(20) for r in range(5)], VOTES)
    assert pooling.pool(df, "majority", 5).where("pred <> row_id % 7").count() == 0


def test_modes(spark):
    df = spark.createDataFrame(random_votes(5), VOTES)
    assert pooling.pool(df, "single").count() == 5
    assert pooling.pool(df, "concatenation", 3).count() == 15
    with pytest.raises(ValueError, match="can't be pooled by"):
        pooling.pool(df, "median")
    assert [n for n, _ in pooling.modes_for(4)] == ["all", "single", "maj_3"]
    assert pooling.modes_for(10)[0] == ("all", "all 10 models")


def test_consensus_with_few_runs(spark):
    votes = random_votes(30, runs=4)
    got = pooling.consensus_table(spark.createDataFrame(votes, VOTES), 4).collect()
    for r in got:
        label, preds = by_row(votes)[r.row_id]
        assert (r.label, r.pred_1, r.pred_maj_5, r.pred_maj_10) == (label, preds[0], None, None)
        assert r.pred_maj_3 == Counter(preds[:3]).most_common(1)[0][0]


def test_consensus_keeps_columns(spark):
    votes = spark.createDataFrame([(1, 0, 2, 2)], VOTES)
    keep = spark.createDataFrame([(1, "t")], "row_id int, text string")
    assert pooling.consensus_table(votes, 1, keep).columns == ["row_id", "text", "pred_1", "pred_maj_3", "pred_maj_5", "pred_maj_10"]


def test_wide_to_votes(spark):
    wide = spark.createDataFrame([(1, 5, 6, 7)], "row_id int, mRS_000 int, mRS_010 int, mRS_x int")
    assert sorted(map(tuple, pooling.wide_to_votes(wide, ["row_id"]).collect())) == [(1, 0, 5), (1, 10, 6)]


def test_metrics_by_mode(spark):
    votes = random_votes()
    rows = {i: v for i, v in by_row(votes).items() if v[0] is not None}
    pairs = {
        "all": [(label, p) for label, preds in rows.values() for p in preds],
        "single": [(label, preds[0]) for label, preds in rows.values()],
    }
    for k in (3, 5, 10):
        pairs[f"maj_{k}"] = [(label, Counter(p[:k]).most_common(1)[0][0]) for label, p in rows.values()]
    df = spark.createDataFrame(votes, VOTES).repartition(5)
    got = {r.mode: (r.n, r.error_rate, r.distance) for r in scoring.metrics_by_mode(df, 10).collect()}
    assert set(got) == set(pairs)
    for mode, items in pairs.items():
        error = np.mean([y != p for y, p in items])
        distance = np.mean([abs(y - p) for y, p in items])
        assert got[mode] == pytest.approx((len(items), error, distance))


def test_unlabelled_rows_do_not_count_but_missing_predictions_do(spark):
    df = spark.createDataFrame([(1, 0, None, 3), (2, 0, 3, -1), (3, 0, -1, -1), (4, 0, 2, 2)], VOTES)
    row = scoring.error_distance(df).first()
    assert (row.n, row.error_rate, row.distance) == (2, 0.5, 2.0)
    nothing = scoring.error_distance(df.where("row_id = 1")).first()
    assert nothing.n == 0 and math.isnan(nothing.error_rate) and math.isnan(nothing.distance)


def test_confusion_matrix_is_full(spark):
    df = spark.createDataFrame([(1, 2), (1, 2), (0, 9), (6, 6)], "y int, p int")
    counted = scoring.cells(df, "y", "p")
    grid = scoring.confusion_matrix(counted, scoring.LABELS).collect()
    assert len(grid) == 49 and sum(r.n for r in grid) == 3
    votes = spark.createDataFrame(random_votes(), VOTES)
    per_mode = scoring.confusion_matrix(benchmark.pooled_cells(votes, 10), (*scoring.LABELS_WITH_SENTINEL, 9), ["mode"])
    totals = {r.mode: r.n for r in per_mode.groupBy("mode").agg(F.sum("n").alias("n")).collect()}
    assert totals == {"all": 3000, "single": 300, "maj_3": 300, "maj_5": 300, "maj_10": 300}


def kappa_by_definition(y, p):
    labels = sorted(set(y) | set(p))
    k = len(labels)
    observed = np.zeros((k, k))
    for a, b in zip(y, p):
        observed[labels.index(a), labels.index(b)] += 1
    expected = np.outer(observed.sum(1), observed.sum(0)) / observed.sum()
    w = np.array([[(i - j) ** 2 for j in range(k)] for i in range(k)])
    return 1 - (w * observed).sum() / (w * expected).sum()


def test_kappa(spark):
    rng = random.Random(3)
    data = [(g, rng.choice([0, 1, 4, 6]), rng.choice([0, 1, 4, 5])) for g in "ab" for _ in range(200)]
    counted = scoring.cells(spark.createDataFrame(data, "rater string, y int, p int"), "y", "p", ["rater"])
    got = {r.rater: r.qwk for r in scoring.quadratic_kappa(counted, ["rater"]).collect()}
    for g in "ab":
        assert got[g] == pytest.approx(kappa_by_definition(*zip(*[(y, p) for k, y, p in data if k == g])))
    same = spark.createDataFrame([(1, 1, 5), (3, 3, 2)], "y int, p int, n int")
    assert scoring.quadratic_kappa(same).first().qwk == 1
    assert math.isnan(scoring.quadratic_kappa(same.where("y = 1")).first().qwk)


def test_class_scores_by_hand(spark):
    counted = spark.createDataFrame([("r", "a", "a", 3), ("r", "a", "b", 1), ("r", "b", "c", 2)], "rater string, y string, p string, n int")
    row = scoring.class_scores(counted).first()
    assert row.accuracy == pytest.approx(0.5)
    assert row.f1_macro == pytest.approx((6 / 7 + 0 + 0) / 3)
    assert row.f1_weighted == pytest.approx(6 / 7 * 4 / 6)


def test_broad_classes_need_complete_rows(spark):
    df = spark.createDataFrame([(0, 1, 2), (3, None, 3), (6, 6, 6), (5, 6, 2)], "expert int, a int, b int")
    got = {r.rater: (r.n, r.accuracy) for r in agreement.broad_class_metrics(df, "expert", ["a", "b"]).collect()}
    assert got == {"a": (3, pytest.approx(2 / 3)), "b": (3, pytest.approx(2 / 3))}


def test_histogram_and_limits(spark):
    counted = spark.createDataFrame([("r", 0, 6, 1), ("r", 3, 3, 2), ("r", 0, 9, 5)], "rater string, y int, p int, n int")
    bins = {r.error: r.density for r in scoring.error_histogram(counted).collect()}
    assert len(bins) == 13 and bins[0] == pytest.approx(2 / 3) and bins[6] == pytest.approx(1 / 3) and bins[-6] == 0
    limits = scoring.bland_altman(counted.where("p < 9")).first()
    diffs = np.array([-6, 0, 0])
    assert (limits.bias, limits.sd) == (pytest.approx(diffs.mean()), pytest.approx(diffs.std()))
    assert limits.upper == pytest.approx(diffs.mean() + 1.96 * diffs.std())


def test_mean_sem_of_one_value(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 3.0)], "g string, v double")
    got = {r.g: (r.mean, r.sem) for r in scoring.mean_sem(df, "v", ["g"]).collect()}
    assert got == {"a": (1.0, None), "b": (2.0, pytest.approx(1.0))}


def test_run_cost(spark):
    log = spark.createDataFrame([("r", 100, 2.0, 3.0), ("r", 50, 5.0, 9.0)], "run string, n_samples bigint, time_per_sample double, memory_gb double")
    assert tuple(scoring.run_cost(log).first()) == ("r", 150, pytest.approx(3.0), 9.0)
    assert tuple(scoring.run_cost(log.where("false"), []).first()) == (0, 0.0, 0.0)


def test_lengths(spark):
    texts = ["a b c", "a", "a  b\nc d", None, "", "a b c"]
    counted = lengths.length_counts(spark.createDataFrame([(t,) for t in texts], "input_text string"))
    values = np.array([3, 1, 4, 0, 3])
    row = lengths.length_stats(counted).first()
    assert (row.n, row["min"], row["max"], row.median) == (5, 0, 4, 3.0)
    assert (row["mean"], row.sd) == (pytest.approx(values.mean()), pytest.approx(values.std(ddof=1)))
    bins = lengths.length_histogram(counted, 4).orderBy("bin").collect()
    expected, edges = np.histogram(values, bins=4, density=True)
    assert [r.density for r in bins] == pytest.approx(list(expected))
    assert [r.low for r in bins] == pytest.approx(list(edges[:-1]))
    kde = lengths.length_kde(counted, 50).orderBy("point").collect()
    width = values.std(ddof=1) * 5 ** (-0.2)
    for r in kde:
        z = (r.x - values) / width
        assert r.density == pytest.approx(np.exp(-0.5 * z**2).sum() / (5 * width * math.sqrt(2 * math.pi)))
    assert (kde[0].x, kde[-1].x) == (pytest.approx(-2.0), pytest.approx(6.0))
    one = lengths.length_counts(spark.createDataFrame([("a b",)], "input_text string"))
    assert sum(r.n for r in lengths.length_histogram(one, 3).collect()) == 1


def test_scores_do_not_depend_on_order_or_partitions(spark):
    votes = random_votes(80)
    frames = [spark.createDataFrame(random.Random(s).sample(votes, len(votes)), VOTES).repartition(s) for s in (1, 3, 11)]
    results = [sorted(map(tuple, scoring.metrics_by_mode(f, 10).collect())) for f in frames]
    assert results[0] == results[1] == results[2]


def test_one_hot_document_and_a_hot_label(spark):
    """A third of all votes belong to one document, and one label covers most rows."""
    votes = [(i, r, 3, r % 4) for i in range(20) for r in range(10)] + [(99, r, 3, r % 3) for r in range(100)]
    df = spark.createDataFrame(votes, VOTES)
    got = {r.row_id: r.pred for r in pooling.pool(df, "majority").collect()}
    assert got[99] == 0 and got[5] == 0
    sample = prepare.balanced_sample(df.where("run_idx = 0"), 4)
    assert sample.count() == 4
