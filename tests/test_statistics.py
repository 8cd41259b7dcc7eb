"""Statistics against direct computation on single rows and against published values."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest

from tallywise.functions import dists
from tallywise.operators import agreement, bootstrap, mixed, scoring, significance
from tallywise.plans import benchmark

RATERS = ["students", "residents", "model"]
SCHEMA = "expert int, students int, residents int, model int"


def ratings(n=400, seed=2, holes=True):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        e = rng.randint(0, 6)
        row = [e] + [min(6, max(0, e + rng.randint(-s, s))) for s in (3, 2, 1)]
        if holes and rng.random() < 0.1:
            row[rng.randint(1, 3)] = None
        rows.append(tuple(row))
    return rows


@pytest.fixture(scope="module")
def frame():
    return pd.DataFrame(ratings(), columns=["expert", *RATERS])


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ratings(), SCHEMA)


def test_distribution_values():
    assert dists.normal_two_sided(1.959963984540054) == pytest.approx(0.05)
    assert dists.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert dists.t_two_sided(1.959963984540054, 1e9) == pytest.approx(0.05, abs=1e-6)
    assert dists.t_two_sided(0.0, 5) == pytest.approx(1.0)
    assert dists.f_quantile(0.95, 5, 10) == pytest.approx(3.3258345, abs=1e-6)
    for d1, d2 in ((1, 1), (2, 30), (99, 99), (1e6, 1e6)):
        for p in (0.025, 0.5, 0.975):
            assert dists.f_cdf(dists.f_quantile(p, d1, d2), d1, d2) == pytest.approx(p, abs=1e-7)
    # a published example of the paired Bayes factor
    assert math.exp(dists.log_jzs_bayes_factor(3.5, 20)) == pytest.approx(17.185, abs=1e-3)
    assert dists.log_jzs_bayes_factor(500.0, 1e6) > 1000


def test_icc(table, frame):
    got = {r.rater: r for r in significance.icc_interval(significance.icc_consistency(agreement.rater_cells(table, "expert", RATERS))).collect()}
    for rater in RATERS:
        x = frame[["expert", rater]].dropna().to_numpy(dtype=float)
        n = len(x)
        grand = x.mean()
        rows = 2 * ((x.mean(1) - grand) ** 2).sum()
        cols = n * ((x.mean(0) - grand) ** 2).sum()
        rest = ((x - grand) ** 2).sum() - rows - cols
        msr, mse = rows / (n - 1), rest / (n - 1)
        assert got[rater].icc == pytest.approx((msr - mse) / (msr + mse))
        f = msr / mse
        q = dists.f_quantile(0.975, n - 1, n - 1)
        assert got[rater].lower == pytest.approx((f / q - 1) / (f / q + 1))
        assert got[rater].upper == pytest.approx((f * q - 1) / (f * q + 1))
        assert got[rater].lower < got[rater].icc < got[rater].upper


def differences(frame, a, b):
    rows = frame[["expert", a, b]].dropna()
    return ((rows[a] - rows.expert).abs() - (rows[b] - rows.expert).abs()).to_numpy(dtype=float)


def test_wilcoxon_and_t(table, frame):
    plan = significance.comparison_plan(table.columns, "model", ["students", "residents"])
    assert list(plan) == ["model vs students", "model vs residents", "students vs residents"]
    counted = significance.error_differences(table, "expert", plan)
    ranks = {r.comparison: r for r in significance.wilcoxon(counted).collect()}
    plain = {r.comparison: r for r in significance.wilcoxon(counted, correction=False).collect()}
    tests = {r.comparison: r for r in significance.paired_t(counted).collect()}
    for name, (a, b) in plan.items():
        d = differences(frame, a, b)
        nz = d[d != 0]
        r = pd.Series(np.abs(nz)).rank().to_numpy()
        w_plus, w_minus, n = r[nz > 0].sum(), r[nz < 0].sum(), len(nz)
        ties = sum(t**3 - t for t in pd.Series(np.abs(nz)).value_counts())
        w, mean = min(w_plus, w_minus), n * (n + 1) / 4
        sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
        assert (ranks[name].n, ranks[name].w_plus, ranks[name].w) == (n, pytest.approx(w_plus), pytest.approx(w))
        assert ranks[name].rbc == pytest.approx((w_plus - w_minus) / (w_plus + w_minus))
        assert plain[name].z == pytest.approx((w - mean) / sd)
        assert ranks[name].z == pytest.approx((w - mean + 0.5) / sd)
        assert plain[name].p_value == pytest.approx(math.erfc(abs(w - mean) / sd / math.sqrt(2)))
        t = d.mean() / (d.std(ddof=1) / math.sqrt(len(d)))
        assert tests[name].t == pytest.approx(t)
        assert tests[name].bf10 == pytest.approx(math.exp(dists.log_jzs_bayes_factor(t, len(d))))


def test_identical_raters_have_no_test(spark):
    df = spark.createDataFrame([(1, 2, 2), (3, 3, 3)], "expert int, a int, b int")
    counted = significance.error_differences(df, "expert", {"a vs b": ("a", "b")})
    assert significance.wilcoxon(counted).count() == 0
    row = significance.paired_t(counted).first()
    assert row.t is None and row.p_value is None


def test_verdicts(spark):
    tests = spark.createDataFrame(
        [("a vs b", 0.01, 0.5, 4.0), ("a vs c", 0.2, 0.1, 0.1), ("b vs c", 0.05, 0.0, 1.0)],
        "comparison string, p_value double, rbc double, bf10 double",
    )
    errors = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 1.0)], "rater string, mae double")
    plan = {"a vs b": ("a", "b"), "a vs c": ("a", "c"), "b vs c": ("b", "c")}
    got = {r.comparison: (r.significance, r.bayes_interpretation, r.winner) for r in significance.verdicts(tests, errors, plan).collect()}
    assert got == {
        "a vs b": ("**Significant**", "Favors difference", "a better"),
        "a vs c": ("Not sig", "Favors equivalence", "TIE"),
        "b vs c": ("Not sig", "Inconclusive", "c better"),
    }


def test_spearman(table, frame):
    errors = pd.DataFrame({r: frame[r] - frame["expert"] for r in RATERS})
    got = {(r.a, r.b): r.rho for r in significance.spearman_errors(table, "expert", RATERS).collect()}
    assert len(got) == 9
    for a in RATERS:
        for b in RATERS:
            both = errors[[a, b]].dropna()
            expected = np.corrcoef(both[a].rank(), both[b].rank() if a != b else both[a].rank())[0, 1] if a != b else 1.0
            assert got[a, b] == pytest.approx(expected)


def expand(y, p, n):
    return np.repeat(y, n), np.repeat(p, n)


def test_bootstrap_metrics_of_one_replicate():
    rng = np.random.default_rng(0)
    y, p = (a.ravel() for a in np.meshgrid([0, 1, 3, 6], [0, 1, 3, 6], indexing="ij"))
    draws = rng.multinomial(60, np.full(16, 1 / 16), size=20)
    draws[:, (y == 3) | (p == 3)] = 0  # label 3 is in no replicate: the scale closes up
    sample = bootstrap.Resamples(y, p, draws)
    for i in range(20):
        a, b = expand(y, p, draws[i])
        labels = sorted(set(a) | set(b))
        place = {v: k for k, v in enumerate(labels)}
        ia, ib = np.array([place[v] for v in a]), np.array([place[v] for v in b])
        k = len(labels)
        observed = np.zeros((k, k))
        np.add.at(observed, (ia, ib), 1)
        w = (np.arange(k)[:, None] - np.arange(k)[None, :]) ** 2
        kappa = 1 - (w * observed).sum() / (w * np.outer(observed.sum(1), observed.sum(0)) / observed.sum()).sum()
        f1 = [2 * ((a == v) & (b == v)).sum() / ((a == v).sum() + (b == v).sum()) for v in labels]
        support = [(a == v).sum() for v in labels]
        assert bootstrap.quadratic_kappa(sample)[i] == pytest.approx(kappa)
        assert bootstrap.f1_macro(sample)[i] == pytest.approx(np.mean(f1))
        assert bootstrap.f1_weighted(sample)[i] == pytest.approx(np.average(f1, weights=support))
        assert bootstrap.distance(sample)[i] == pytest.approx(np.abs(a - b).mean())
        assert bootstrap.error_rate(sample)[i] == pytest.approx((a != b).mean())
        assert bootstrap.within_one(sample)[i] == pytest.approx((np.abs(a - b) <= 1).mean())


def test_bootstrap_agrees_with_row_resampling(table, frame):
    counted = agreement.rater_cells(table, "expert", RATERS)
    got = bootstrap.bootstrap_ci(counted, ["mae", "exact_acc", "qwk"], replicates=2000)
    got = {(r.rater, r.metric): r for r in got.collect()}
    rng = np.random.default_rng(9)
    for rater in RATERS:
        rows = frame[["expert", rater]].dropna().to_numpy(dtype=int)
        picks = rng.integers(0, len(rows), size=(2000, len(rows)))
        off = np.abs(rows[:, 0] - rows[:, 1])[picks]
        for metric, scores in (("mae", off.mean(1)), ("exact_acc", (off == 0).mean(1))):
            r = got[rater, metric]
            spread = scores.std()
            assert r.lower == pytest.approx(np.percentile(scores, 2.5), abs=0.25 * spread)
            assert r.upper == pytest.approx(np.percentile(scores, 97.5), abs=0.25 * spread)
            assert r.used == 2000 and r.n == len(rows)
        qwk = got[rater, "qwk"]
        assert qwk.lower < qwk.estimate < qwk.upper


def test_bootstrap_is_the_same_on_any_partitioning(table):
    counted = agreement.rater_cells(table, "expert", RATERS)
    one = bootstrap.bootstrap_ci(counted.coalesce(1), ["mae"], replicates=50).collect()
    other = bootstrap.bootstrap_ci(counted.repartition(9), ["mae"], replicates=50).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, other))


def test_bootstrap_edges(spark):
    single = spark.createDataFrame([("g", 2, 2, 10)], "rater string, y int, p int, n int")
    row = bootstrap.bootstrap_ci(single, ["qwk"], replicates=20).first()
    assert (row.used, row.lower, row.estimate) == (0, None, None)
    mixed_cells = spark.createDataFrame([("g", -1, 2, 10), ("h", 1, 2, 5), ("h", 1, 1, 5)], "rater string, y int, p int, n int")
    got = {r.rater: (r.err_low, r.err_high) for r in bootstrap.bootstrap_halfwidth(mixed_cells, "error", replicates=200).collect()}
    assert got["g"] == (0.0, 0.0) and got["h"][0] > 0 and got["h"][1] > 0
    assert {tuple(r)[1:] for r in bootstrap.bootstrap_halfwidth(mixed_cells, "unknown").collect()} == {(0.0, 0.0)}


def dense_reml(rows, theta):
    """Restricted likelihood of the random intercept model from full matrices."""
    groups = sorted({r[0] for r in rows})
    x = np.array([[1.0, math.log10(r[1]), r[2], math.log10(r[1]) * r[2]] for r in rows])
    y = np.array([r[3] for r in rows])
    z = np.array([[1.0 if r[0] == g else 0.0 for g in groups] for r in rows])
    v = np.eye(len(y)) + theta * z @ z.T
    vi = np.linalg.inv(v)
    a = x.T @ vi @ x
    beta = np.linalg.solve(a, x.T @ vi @ y)
    r = y - x @ beta
    free = len(y) - x.shape[1]
    scale = r @ vi @ r / free
    loss = free * math.log(scale) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1]
    return loss, beta, scale, np.sqrt(np.diag(np.linalg.inv(a)) * scale)


def test_mixed_model(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(9):
        shift = rng.normal(0, 0.5)
        for _ in range(int(rng.integers(3, 9))):
            size, bits = float(rng.uniform(1, 70)), float(rng.integers(2, 9))
            rows.append((f"m{g}", size, bits, 0.9 - 0.2 * math.log10(size) - 0.01 * bits + shift + rng.normal(0, 0.2)))
    df = spark.createDataFrame(rows + [("m0", None, 2.0, 1.0)], "model string, nparams double, nbits double, target double")
    fit = mixed.random_intercept_fit(df).collect()
    theta = fit[0].group_var / fit[0].residual_var
    loss, beta, scale, errors = dense_reml(rows, theta)
    assert [r.term for r in fit] == ["intercept", "log_nparams", "nbits", "log_nparams:nbits"]
    assert [r.coef for r in fit] == pytest.approx(list(beta))
    assert [r.std_err for r in fit] == pytest.approx(list(errors))
    assert fit[0].residual_var == pytest.approx(scale)
    assert loss <= min(dense_reml(rows, t)[0] for t in theta * np.array([0.5, 0.9, 0.99, 1.01, 1.1, 2.0]))
    simple = mixed.random_intercept_fit(df, design=mixed.size_and_bits_design(interaction=False)).collect()
    assert [r.term for r in simple] == ["intercept", "log_nparams", "nbits"]


def test_reports(table):
    report = benchmark.rater_report(table, "expert", RATERS, replicates=100).collect()
    assert {r.rater for r in report} == set(RATERS)
    for r in report:
        assert r.mae_lower <= r.mae <= r.mae_upper and r.icc_lower < r.icc < r.icc_upper
        assert r.mae_text == f"{r.mae:.3f} [{r.mae_lower:.3f}-{r.mae_upper:.3f}]"
    tests = benchmark.significance_report(table, "expert", "model", ["students", "residents"]).collect()
    assert {r.winner for r in tests} == {"model better", "residents better"}


def test_inter_rater_and_self_agreement(spark):
    pairs = spark.createDataFrame([(1, 1, None, 2), (2, 3, None, 2), (None, 4, None, 1)], "a int, b int, c int, d int")
    got = agreement.inter_rater(agreement.pair_cells(pairs, {"ab": ("a", "b"), "cd": ("c", "d")})).collect()
    assert [(r.category, r.n, r.mae, r.exact_acc) for r in got] == [("ab", 2, 0.5, 0.5)]
    votes = spark.createDataFrame([(1, 0, 2), (1, 9, 2), (2, 0, 3), (3, 0, 1), (3, 9, None)], "row_id int, run_idx int, pred int")
    assert [tuple(r) for r in agreement.self_cells(votes).collect()] == [(2, 2, 1)]
    assert agreement.self_cells(votes, (0, 5)).count() == 0


def test_user_metric_sees_cells(table, frame):
    counted = agreement.rater_cells(table, "expert", RATERS)
    got = {r.rater: r.worst for r in scoring.cell_metric(counted, {"worst": lambda y, p, n: abs(y - p).max()}).collect()}
    assert got == {r: float((frame[r] - frame["expert"]).abs().max()) for r in RATERS}


def test_exact_signed_rank_counts_all_signs(spark):
    """Few pairs: every way to give the ranks signs; more pairs: the normal approximation as before."""
    draw = random.Random(4)
    groups = {g: [draw.choice([-3, -2, -1, 0, 1, 2, 3, 4]) for _ in range(n)] for g, n in enumerate([1, 2, 5, 8, 11, 12, 40])}
    groups[7], groups[8] = [0, 0], [5, 7, 9, -1, -2]
    rows = [(g, d, ds.count(d)) for g, ds in groups.items() for d in set(ds)]
    differences = spark.createDataFrame(rows, "g int, d int, n long")
    found = {r.g: r for r in significance.wilcoxon(differences, by=["g"], exact_upto=12).collect()}
    plain = {r.g: r for r in significance.wilcoxon(differences, by=["g"]).collect()}
    for g, ds in groups.items():
        used = [d for d in ds if d]
        if not used:
            assert g not in found
            continue
        if len(used) > 12:
            assert found[g].method == "normal" and found[g].p_value == plain[g].p_value
            continue
        ranks = [sum(abs(x) < abs(d) for x in used) + (sum(abs(x) == abs(d) for x in used) + 1) / 2 for d in used]
        w = min(sum(r for r, d in zip(ranks, used) if d > 0), sum(r for r, d in zip(ranks, used) if d < 0))
        sums = [sum(r for r, s in zip(ranks, signs) if s) for signs in itertools.product([0, 1], repeat=len(ranks))]
        assert found[g].method == "exact" and found[g].w == w
        assert found[g].p_value == pytest.approx(min(1, 2 * sum(s <= w for s in sums) / len(sums)))
    with pytest.raises(ValueError, match="at most"):
        significance.wilcoxon(differences, by=["g"], exact_upto=51)


def test_exact_signed_rank_of_fifty_pairs():
    """Without ties the number of subsets with a sum follows the usual recursion, in whole numbers."""
    from tallywise.functions.dists import signed_rank_two_sided

    ways = [1]
    for rank in range(1, 51):
        ways = [(ways[s] if s < len(ways) else 0) + (ways[s - rank] if s >= rank else 0) for s in range(len(ways) + rank)]
    for w in (0, 100, 400, 600, 637):
        exact = min(1, 2 * sum(ways[: w + 1]) / 2**50)
        assert signed_rank_two_sided(w, [(2 * r, 1) for r in range(1, 51)]) == pytest.approx(exact, rel=1e-12)
