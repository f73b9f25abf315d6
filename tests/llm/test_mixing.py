"""Mixing: posteriors, targets, optimality, edge rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.llm import mixing

DIR = "/root/testdata/sf0.01"
DOMAINS = ("de", "en", "es", "fr")
WEIGHTS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return mixing.train(docs.filter("doc_id % 2 = 0"), DOMAINS, domain_col="lang")


def table(df):
    rows = df.orderBy("doc_id").collect()
    return np.array([r["tokens"] for r in rows], float), np.array([r["posterior"] for r in rows]), np.array([r["rate"] for r in rows]), rows


def test_posteriors_tell_the_language(docs, model):
    t, p, _, rows = table(mixing.mix(docs, model, WEIGHTS))
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    odd = [r["doc_id"] % 2 == 1 and r["tokens"] >= 30 for r in rows]
    right = [DOMAINS[int(np.argmax(r["posterior"]))] == lang[r["doc_id"]] for r in rows]
    assert np.mean(np.array(right)[odd]) > 0.95
    assert np.allclose(p.sum(axis=1), 1)
    # Half of each language: soft membership.
    half = " ".join(["the of and to"] * 40 + ["der die und das"] * 40)
    _, q = model.posteriors(mixing.pa.array([half, half + " " + half]))
    assert (q[:, :2] > 0.1).all() and abs(q[0] - q[1]).max() < 0.02


@pytest.mark.parametrize(("total", "lowest"), [(None, 0.0), (None, 1.0), (50_000.0, 0.0)])
def test_totals_meet_the_targets(docs, model, total, lowest):
    t, p, rate, rows = table(mixing.mix(docs, model, WEIGHTS, total, lowest))
    totals = (rate * t) @ p
    shares = np.array([WEIGHTS[d] for d in DOMAINS])
    asked = total if total is not None else mixing.least_total(t @ p, shares)
    assert np.abs(totals / asked - shares).max() < 0.01
    assert (rate >= lowest).all()
    copies = np.array([r["copies"] for r in rows])
    assert (np.abs(copies - rate) < 1).all()
    assert abs((copies * t).sum() / (rate * t).sum() - 1) < (0.1 if total is None else 0.3)


def frame(spark, t, p):
    return spark.createDataFrame([(int(x), [float(y) for y in row]) for x, row in zip(t, p, strict=True)], "tokens long, posterior array<double>").repartition(3)


@pytest.fixture
def quick(monkeypatch):
    """The passes over rows that lie here; one test holds them against Spark's."""
    def summed(table, sums, size):
        found = sums(*table)
        return found, found

    def use():
        monkeypatch.setattr(mixing, "_summed", summed)

    return use


def optimal(t, p, rate, target, lowest, highest, slack):
    """The gradient vanishes where a rate is free and pushes outward at its bounds."""
    gradient = p @ ((rate * t) @ p - target) / target.sum()
    assert (rate >= lowest).all() and (rate <= highest).all()
    assert np.abs(gradient[(rate > lowest) & (rate < highest)]).max(initial=0) < slack
    assert gradient[rate <= lowest].min(initial=0) > -slack and gradient[rate >= highest].max(initial=0) < slack


@pytest.mark.parametrize("highest", [np.inf, 2.0])
def test_rates_are_nearest_in_least_squares(spark, highest):
    """Where targets can't be met, no small feasible change of the rates is better."""
    rng = np.random.default_rng(3)
    p, t = rng.dirichlet([0.3] * 3, 60), rng.integers(1, 50, 60).astype(float)
    weights, total, lowest = np.array([0.9, 0.1, 0.0]), float(t.sum()), 0.5
    rate = mixing.rates(p, mixing.fit_rates(frame(spark, t, p), weights, total, lowest, highest), lowest, highest)
    assert 0 < (rate > lowest).sum() < len(rate)
    optimal(t, p, rate, weights * total, lowest, highest, 1.1e-6)


def test_passes_over_partitions_agree_with_one(spark):
    rng = np.random.default_rng(4)
    p, t = rng.dirichlet([0.3] * 3, 50), rng.integers(0, 50, 50).astype(float)
    steps = [(np.array([1.0, -2.0, 0.5]), np.array([0.1, -0.2, 0.05])), (np.array([0.3, 0.1, -0.4]), np.array([0.3, 0.1, -0.4]))]
    now = mixing.rates(p, steps, 0.9, 1.3)
    assert (now >= 0.9).all() and (now <= 1.3).all() and len(set(now)) > 10
    df = frame(spark, t, p)
    none = (np.zeros(3), np.zeros(3))
    assert np.allclose(mixing._trials(df, steps, [none, steps[0]], 0.9, 1.3, 3), [(now * t) @ p, (mixing.rates(p, [*steps, steps[0]], 0.9, 1.3) * t) @ p])
    gradient = np.array([0.2, -0.1, 0.1])
    moments, largest = mixing._free(df, steps, gradient, 0.9, 1.3)
    free = ~(((now <= 0.9) & (p @ gradient > 0)) | ((now >= 1.3) & (p @ gradient < 0)))
    assert np.allclose(moments, (p[free] * t[free, None]).T @ p[free]) and np.isclose(largest, np.abs(p @ gradient)[free & (t > 0)].max())


@pytest.mark.parametrize(("sharp", "lowest", "highest"), [(0.05, 0.0, np.inf), (0.05, 1.0, np.inf), (0.3, 0.0, np.inf), (0.05, 1.0, 5.0), (0.3, 0.2, 50.0)])
def test_rare_domain_meets_its_target(quick, sharp, lowest, highest):
    """A domain of 0.05 % of the tokens, with the constants as they are."""
    rng = np.random.default_rng(7)
    shares, weights = np.array([0.65, 0.2, 0.1495, 0.0005]), np.array([0.4, 0.2, 0.2, 0.2])
    p = rng.dirichlet([sharp] * 4, 6000) * sharp + (1 - sharp) * np.eye(4)[rng.choice(4, 6000, p=shares)]
    t = rng.integers(20, 800, 6000).astype(float)
    quick()
    rate = mixing.rates(p, mixing.fit_rates((t, p), weights, None, lowest, highest), lowest, highest)
    target = weights * mixing.least_total(t @ p, weights)
    optimal(t, p, rate, target, lowest, highest, 1.1e-6)
    if lowest == 0:
        assert np.abs(((rate * t) @ p - target) / target).max() < 1e-5


def test_absent_domain_is_no_reason_for_endless_copies(quick):
    """Stray posterior of a domain that no document is of: the upper rate bounds what it asks for."""
    rng = np.random.default_rng(9)
    p = np.hstack([rng.dirichlet([0.2] * 3, 2000) * 0.999, rng.uniform(0, 0.002, (2000, 1))])
    p, t = p / p.sum(axis=1, keepdims=True), rng.integers(1, 200, 2000).astype(float)
    weights = np.array([0.4, 0.2, 0.2, 0.2])
    quick()
    target = weights * mixing.least_total(t @ p, weights)
    rate = mixing.rates(p, mixing.fit_rates((t, p), weights, None, 1.0, 20.0), 1.0, 20.0)
    optimal(t, p, rate, target, 1.0, 20.0, 1e-5)


def test_a_fit_cut_short_gives_the_nearest_met(quick, monkeypatch):
    """A fit that ends early warns and is no worse than the start; each further step is nearer."""
    rng = np.random.default_rng(3)
    p, t = rng.dirichlet([0.3] * 3, 60), rng.integers(1, 50, 60).astype(float)
    weights, total = np.array([0.9, 0.1, 0.0]), float(t.sum())
    quick()
    left = []
    for rounds in (1, 2, 4):
        monkeypatch.setattr(mixing, "ROUNDS", rounds)
        with pytest.warns(UserWarning, match="projected gradient"):
            steps = mixing.fit_rates((t, p), weights, total, 0.5)
        left.append(((((mixing.rates(p, steps, 0.5) * t) @ p) - weights * total) ** 2).sum())
    assert ((t @ p - weights * total) ** 2).sum() > left[0] > left[1] > left[2]


def test_long_labelled_texts_teach(spark):
    """A text of 300 KB reaches the word counts; nothing is left out for its length."""
    rows = [(1, "zig zag " * 40_000, "de"), (2, "the of and " * 20, "en"), (3, "to in a " * 20, "en")]
    model = mixing.train(spark.createDataFrame(rows, "id int, text string, domain string"), ("de", "en"))
    _, p = model.posteriors(mixing.pa.array(["zig zag zig", "the of and to"]))
    assert p[0, 0] > 0.8 and p[1, 1] > 0.8


def test_edges(spark, docs, model):
    rows = [(1, None, 2.0), (2, "", 2.0), (3, "the of", 2.0), (3, "the of", 2.0), (None, "der und", 2.0), (4, "the " * 50_000, 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rate double")
    got = mixing.mix(df, model, WEIGHTS).collect()
    assert len(got) == 6 and all(r["rate"] >= 0 for r in got)
    assert {r["tokens"] for r in got if r["doc_id"] in (1, 2)} == {0}
    assert len({(r["rate"], r["copies"]) for r in got if r["doc_id"] == 3}) == 1
    assert mixing.mix(df.limit(0), model, WEIGHTS).count() == 0
    blank = mixing.train(docs.limit(0), DOMAINS, domain_col="lang")
    assert mixing.mix(df, blank, WEIGHTS).filter(F.abs(F.col("posterior")[0] - 0.25) < 1e-9).count() == 6
    one = mixing.train(docs, ("en",), domain_col="lang")
    assert mixing.mix(docs, one, {"en": 1.0}).filter("abs(rate - 1) > 1e-6").count() == 0
    with pytest.raises(ValueError):
        mixing.mix(df, model, {"xx": 1.0})
    with pytest.raises(ValueError):
        mixing.mix(df, model, WEIGHTS, lowest=2.0, highest=1.0)
    capped = mixing.mix(df, model, WEIGHTS, highest=0.5).collect()
    assert len(capped) == 6 and all(r["rate"] <= 0.5 for r in capped)
