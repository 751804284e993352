from datetime import timedelta

import numpy as np
import pytest
from helpers import START, bars, sequential_filter, sequential_path, walk
from pyspark.sql import functions as F

from barwright.operators import blocked_fit, drift, evaluate, fit, hmm, report
from barwright.operators.features import features, trainable
from barwright.plans import scan
from barwright.plans.frames import LASTING, SAMPLE_MODEL, TWO_STATES
from barwright.sources.schema import MODEL


def vectors(spark, x, symbol="NQ"):
    rows = [(symbol, START, i, i, [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, seq bigint, bar_no bigint, features array<double>")


@pytest.mark.parametrize(("block", "scale"), [(1, 1), (7, 3), (500, 1), (9, 100)])
def test_forward_filter_equals_the_sequential_one(spark, block, scale):
    x = scale * np.random.default_rng(42).standard_normal((60, 6))
    found = hmm.filtered(vectors(spark, x), SAMPLE_MODEL, block).orderBy("bar_no").collect()
    probabilities, steps = sequential_filter(x, SAMPLE_MODEL)
    assert np.abs(np.array([r.state_probs for r in found]) - probabilities).max() < 1e-9
    assert np.allclose([r.step_ll for r in found], steps)
    assert np.allclose([sum(r.state_probs) for r in found], 1)


def test_forward_filter_where_its_floor_acts(spark):
    """A model that forbids changes of state, and bars that only another state explains: the recursion is not linear there."""
    model = SAMPLE_MODEL | {"transition_matrix": [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], "initial_probs": [1.0, 0.0, 0.0]}
    x = np.random.default_rng(8).standard_normal((200, 6))
    x[60:63] *= 90
    x[130] *= 300
    x[150:] *= 40
    probabilities, steps = sequential_filter(x, model)
    for block in (5, 64, 500):
        found = hmm.filtered(vectors(spark, x), model, block).orderBy("bar_no").collect()
        assert np.abs(np.array([r.state_probs for r in found]) - probabilities).max() < 1e-9
        assert np.allclose([r.step_ll for r in found], steps)
    far = np.full((5, 6), 1e200)
    assert all(np.allclose(r.state_probs, 1 / 3) and r.step_ll == 0 for r in hmm.filtered(vectors(spark, far), model, 2).collect())


def test_floor_in_long_series_needs_no_rows_in_the_chain(spark, monkeypatch):
    """Models with zero transitions, over many blocks: summaries stay small, and what a wrong guess touches is run again."""
    sizes = []
    plain = scan.Forward.advance
    monkeypatch.setattr(scan.Forward, "advance", lambda self, state, summary: (sizes.append(len(summary)), plain(self, state, summary))[1])
    turns = {
        "cycle": [[0.7, 0.3, 0.0], [0.0, 0.6, 0.4], [0.5, 0.0, 0.5]],
        "trap": [[0.5, 0.5, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]],
        "apart": [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]],
    }
    for seed, (name, transition) in enumerate(turns.items()):
        model = SAMPLE_MODEL | {"transition_matrix": transition, "initial_probs": [1.0, 0.0, 0.0]}
        x = np.random.default_rng(seed).standard_normal((3000, 6))
        x[700:760] *= 30
        x[1500:1503, 0] = np.nan
        x[2200] = np.inf
        with np.errstate(all="ignore"):
            probabilities, steps = sequential_filter(x, model)
        found = hmm.filtered(vectors(spark, x), model, 100).orderBy("bar_no").collect()
        assert np.abs(np.array([r.state_probs for r in found]) - probabilities).max() < 1e-9, name
        assert np.allclose([r.step_ll for r in found], steps), name
    assert all(n == 12 for n in sizes)


def test_wrong_guesses_are_run_again(spark, monkeypatch):
    """Guesses that are no use at all: the blocks settle one after another, whatever the model forgets."""
    monkeypatch.setattr(scan.Forward, "advance", lambda self, state, summary: [1 / 3] * 3)
    model = SAMPLE_MODEL | {"transition_matrix": [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], "initial_probs": [0.2, 0.3, 0.5]}
    x = 0.1 * np.random.default_rng(3).standard_normal((120, 6))
    found = hmm.filtered(vectors(spark, x), model, 40).orderBy("bar_no").collect()
    assert np.abs(np.array([r.state_probs for r in found]) - sequential_filter(x, model)[0]).max() < 1e-9


def versions_of(spark, rows):
    found = [model | {"symbol": symbol, "metadata": model["metadata"] | {"trained_at": version}, "valid_from": start} for symbol, version, start, model in rows]
    return spark.createDataFrame(found, f"{MODEL}, valid_from timestamp")


@pytest.mark.parametrize("block", [7, 64, 1000])
def test_each_symbol_is_scored_by_its_own_model(spark, block):
    """Models of two and three states, changes in mid-series (also on a block's edge), one symbol without a model, one late model."""
    at = lambda i: START + timedelta(minutes=i)
    plan = [("A", "1", None, SAMPLE_MODEL), ("B", "1", None, TWO_STATES), ("C", "1", at(0), TWO_STATES), ("C", "2", at(70), SAMPLE_MODEL), ("C", "3", at(71), TWO_STATES), ("D", "1", at(50), LASTING)]
    x = {s: np.random.default_rng(i).standard_normal((150, 6)) for i, s in enumerate("ABCDE")}
    rows = [(s, at(i), i, i, "mine", [float(v) for v in row]) for s, values in x.items() for i, row in enumerate(values)]
    frame = spark.createDataFrame(rows, "symbol string, ts timestamp, seq bigint, bar_no bigint, model_version string, features array<double>")
    models = versions_of(spark, plan)
    scored = hmm.filtered(frame, models, block).collect()
    paths = {(r.symbol, r.bar_no): r for r in hmm.viterbi(frame, models, block).collect()}
    spans = [("A", "1", 0, 150, SAMPLE_MODEL), ("B", "1", 0, 150, TWO_STATES), ("C", "1", 0, 70, TWO_STATES), ("C", "2", 70, 71, SAMPLE_MODEL), ("C", "3", 71, 150, TWO_STATES), ("D", "1", 50, 150, LASTING)]
    expected = {}
    for symbol, version, first, last, model in spans:
        probabilities, steps = sequential_filter(x[symbol][first:last], model)
        for i, state in enumerate(sequential_path(x[symbol][first:last], model)):
            expected[symbol, first + i] = version, probabilities[i], steps[i], state
    assert {(r.symbol, r.bar_no) for r in scored} == set(expected) == set(paths)
    for r in scored:
        version, probabilities, step, state = expected[r.symbol, r.bar_no]
        assert r.model_version == version and np.abs(np.array(r.state_probs) - probabilities).max() < 1e-9 and abs(r.step_ll - step) < 1e-6
        assert r.state == int(np.argmax(probabilities)) and paths[r.symbol, r.bar_no].state == state and paths[r.symbol, r.bar_no].model_version == version


def test_without_times_the_model_trained_last_is_in_force(spark):
    x = np.random.default_rng(5).standard_normal((30, 6))
    models = versions_of(spark, [("NQ", "2024", None, SAMPLE_MODEL), ("NQ", "2025", None, TWO_STATES)])
    for table in (models.drop("valid_from"), models):
        found = hmm.filtered(vectors(spark, x), table, 8).orderBy("bar_no").collect()
        assert {r.model_version for r in found} == {"2025"}
        assert np.allclose([r.state_probs for r in found], sequential_filter(x, TWO_STATES)[0])
    assert hmm.filtered(vectors(spark, x).limit(0), models).count() == 0
    assert hmm.filtered(vectors(spark, x), models.limit(0)).count() == 0


@pytest.mark.parametrize("n", [2, 63, 64, 65, 200])
def test_smoothing_in_chunks_equals_the_plain_one(n):
    random = np.random.default_rng(n)
    log_e, initial, move = 5 * random.standard_normal((n, 3)), np.array([0.2, 0.5, 0.3]), np.array(SAMPLE_MODEL["transition_matrix"])
    alpha, beta = np.empty((n, 3)), np.ones((n, 3))
    e = np.exp(log_e)
    for t in range(n):
        alpha[t] = (initial if t == 0 else alpha[t - 1] @ move) * e[t]
        alpha[t] /= alpha[t].sum()
    for t in range(n - 2, -1, -1):
        beta[t] = move @ (e[t + 1] * beta[t + 1])
        beta[t] /= beta[t].sum()
    gamma = alpha * beta / (alpha * beta).sum(axis=1, keepdims=True)
    pairs = sum((p := np.outer(alpha[t], e[t + 1] * beta[t + 1]) * move) / p.sum() for t in range(n - 1))
    state, total = initial * e[0], 0.0
    for t in range(n):
        state = initial * e[0] if t == 0 else (state @ move) * e[t]
        total, state = total + np.log(state.sum()), state / state.sum()
    found = fit._smooth(log_e, initial, move)
    assert np.allclose(found[0], gamma) and np.allclose(found[1], pairs) and np.isclose(found[2], total)


@pytest.mark.parametrize("block", [1, 7, 500])
def test_best_path_equals_the_sequential_one(spark, block):
    x = 2 * np.random.default_rng(1).standard_normal((50, 6))
    found = [r.state for r in hmm.viterbi(vectors(spark, x), SAMPLE_MODEL, block).orderBy("bar_no").collect()]
    assert found == sequential_path(x, SAMPLE_MODEL)


def test_validation_names_what_is_wrong(spark):
    from barwright.plans.frames import SAMPLE_MODEL as good

    broken = [({}, None), ({"schema_version": 99}, "schema version 99"), ({"symbol": "INVALID"}, "unknown symbol: INVALID"), ({"initial_probs": [0.5, 0.5]}, "initial_probs has the wrong length")]
    broken += [({"transition_matrix": [[1.0, 0.0], [0.0, 1.0]]}, "transition_matrix has the wrong shape"), ({"means": good["means"][:2]}, "means has the wrong shape"), ({"feature_mean": [0.0, 0.0]}, "feature_mean has the wrong length")]
    broken += [({"variances": [[1.0]] * 3}, "variances has the wrong shape"), ({"k": 11}, "k is out of range")]
    broken += [({name: None}, f"missing field: {name}") for name in ("k", "metadata", "regime_labels")]
    rows = hmm.validated(spark.createDataFrame([good | change for change, _ in broken], MODEL)).select("error").collect()
    assert [r.error for r in rows] == [message for _, message in broken]


def test_fit_improves_and_orders_states(spark):
    random = np.random.default_rng(3)
    x = np.concatenate([random.normal(0, 1, (150, 6)), random.normal(4, 3, (150, 6))])
    found = fit.best(fit.fits(vectors(spark, x), ["symbol"], k=2, restarts=2, iterations=30), ["symbol"]).first()
    assert sum(found.variances[0]) <= sum(found.variances[1])
    assert abs(sum(found.initial_probs) - 1) < 1e-9 and all(abs(sum(r) - 1) < 1e-9 for r in found.transition_matrix)
    assert abs(found.means[0][0]) < 1 and abs(found.means[1][0] - 4) < 1
    scores = [fit.expectation_maximisation(x, 2, 1, n, 0)["log_likelihood"] for n in (1, 3, 9)]
    assert scores == sorted(scores)


def many(spark, series):
    rows = [(name, 0, at + i, [float(v) for v in row]) for name, at, x in series for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "symbol string, window_idx int, bar_no bigint, features array<double>").repartition(5)


def test_blocked_fit_equals_the_whole_one(spark):
    """Series of one block, of several, of a block's exact length and not from a block's edge on; converged fits and others."""
    dice = np.random.default_rng(12)
    mixed = lambda n: np.where(dice.random((n, 1)) < 0.5, dice.normal(0, 1, (n, 3)), dice.normal(3, 2, (n, 3)))
    series = [("A", 0, mixed(300)), ("B", 37, mixed(64)), ("C", 0, mixed(128)), ("D", 5, mixed(2)), ("E", 0, np.ones((70, 3)))]
    for iterations in (1, 6):
        found = {(r.symbol, r.restart): r for r in blocked_fit.fits(many(spark, series), ["symbol", "window_idx"], 2, 2, iterations, 0.5, block=64).collect()}
        assert set(found) == {(s, r) for s in "ABCE" for r in (0, 1)}
        for name, _, x in series:
            for restart in (0, 1) if name != "D" else ():
                whole, r = fit.canonical(fit.expectation_maximisation(x, 2, 42 * restart + 1, iterations, 0.5)), found[name, restart]
                for column in blocked_fit.PARAMETERS:
                    assert np.abs(np.array(r[column]) - np.array(whole[column])).max() < 1e-9, (name, restart, column)
                assert abs(r.log_likelihood - whole["log_likelihood"]) < 1e-6 and (r.converged, r.n_iterations, r.n_rows) == (whole["converged"], whole["n_iterations"], len(x))


def test_long_series_are_fitted_in_blocks(spark, monkeypatch):
    dice = np.random.default_rng(13)
    rows = many(spark, [("long", 0, dice.standard_normal((90, 2))), ("short", 0, dice.standard_normal((60, 2)))])
    both = [sorted(map(str, fit.fits(rows, ["symbol"], 2, 1, 3, long=long).select("symbol", "restart", "n_iterations", "n_rows", F.round("log_likelihood", 6)).collect())) for long in (80, 10**6)]
    assert both[0] == both[1] and len(both[0]) == 2
    assert blocked_fit.fits(rows.limit(0), ["symbol"], 2, 1, 2).count() == 0


def test_trained_models_are_sound(spark):
    rows = trainable(features(bars(spark, walk(400))))
    trained = fit.models(rows, k=3, restarts=1, iterations=5)
    assert hmm.validated(trained).first().error is None
    assert fit.fits(rows.limit(2), ["symbol"], k=3, restarts=1).count() == 0


def test_walk_forward_windows(spark):
    x = np.random.default_rng(0).standard_normal((400, 6))
    windows, summary = evaluate.walk_forward(vectors(spark, x), 2, 200, 100, 100, restarts=1, iterations=5)
    found = windows.orderBy("window_idx").collect()
    assert [(r.start, r.train_end, r.test_end) for r in found] == [(0, 200, 300), (100, 300, 400)]
    assert summary.first().n_windows == 2 and all(0 <= r.stability <= 1 for r in found)
    assert evaluate.window_plan(vectors(spark, x), 300, 101, 50).count() == 0
    assert evaluate.window_plan(vectors(spark, x), 300, 100, 50).count() == 1


def test_stability_and_dominant_state(spark):
    rows = [(name, i, s) for name, states in {"a": [0] * 5, "b": [0, 1, 0, 1, 0], "c": [2], "d": [1, 0]}.items() for i, s in enumerate(states)]
    states = spark.createDataFrame(rows, "symbol string, bar_no int, state int")
    assert {r.symbol: r.stability for r in evaluate.stability(states).collect()} == {"a": 1.0, "b": 0.0, "c": 1.0, "d": 0.0}
    assert {r.symbol: r.dominant_regime for r in evaluate.dominant(states).collect()} == {"a": "low_vol", "b": "low_vol", "c": "high_vol", "d": "low_vol"}


def evidence(spark, states, ll=-2.5, shift=0.0):
    from barwright.sources.schema import FEATURES

    random = np.random.default_rng(5)
    rows = [("NQ", START, i, int(s), float(ll), *(float(v) for v in random.standard_normal(6) + shift)) for i, s in enumerate(states)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, seq bigint, state int, step_ll double, " + ", ".join(f"{f} double" for f in FEATURES))


def test_drift_measures(spark):
    models = spark.createDataFrame([SAMPLE_MODEL | {"feature_mean": [0.0] * 6, "feature_std": [1.0] * 6}], MODEL)
    even, stuck = evidence(spark, [i % 3 for i in range(300)]), evidence(spark, [0] * 200)
    assert drift.occupancy(even, 3).first().occupancy_drift < 0.1 < drift.occupancy(stuck, 3).first().occupancy_drift
    random, state, chain = np.random.default_rng(9), 0, []
    for _ in range(500):
        state = int(random.choice(3, p=SAMPLE_MODEL["transition_matrix"][state]))
        chain.append(state)
    assert drift.transitions(evidence(spark, chain), models).first().transition_drift < 0.5
    assert drift.transitions(evidence(spark, [0] * 9), models).first().transition_drift == 0
    assert drift.likelihood_drop(even, models).first().likelihood_drop < 0.01
    moved = drift.feature_drift(evidence(spark, [0] * 100, shift=5.0), models).collect()
    assert all(r.drift > 1 for r in moved)
    assert all(r.drift == 0 for r in drift.feature_drift(evidence(spark, [0] * 20, shift=5.0), models).collect())
    decided = drift.decision(drift.metrics(evidence(spark, [0] * 200, shift=5.0), models, 3)).first()
    assert decided.retrain and decided.reasons[0] == "occupancy" and sum(r.startswith("feature") for r in decided.reasons) == 1
    assert not drift.decision(drift.metrics(evidence(spark, [0] * 50), models, 3)).first().retrain


def test_requests_and_reports(spark):
    models = spark.createDataFrame([SAMPLE_MODEL], MODEL)
    asked = spark.createDataFrame([("infer", "NQ", [0.0] * 6), ("infer", "ZB", [0.0] * 6), ("infer", "NQ", [1.0, 2.0]), ("unknown", "NQ", [0.0] * 6), (None, None, None)], "type string, symbol string, features array<double>")
    good, errors = hmm.answered(asked, models)
    assert good.count() == 1
    assert sorted(r.code for r in errors.collect()) == ["INVALID_FEATURES", "INVALID_REQUEST", "INVALID_REQUEST", "MODEL_NOT_FOUND"]
    later = models.withColumn("metadata", F.col("metadata").withField("trained_at", F.lit("2027"))).withColumn("k", F.lit(4))
    assert report.latest_models(models.unionByName(later)).first().k == 4
    assert report.transition_table(models).where("from_label = 'low_vol' and to_label = 'high_vol'").first().probability == 0.05
