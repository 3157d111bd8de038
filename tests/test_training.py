"""Many experiments in the same scans against plain loops of each: steps, averages, noise, ledgers, checkpoints."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fedspark.functions.hashing import gauss_of, hash_gauss, hash_hex
from fedspark.operators import experiment, federated, metrics, report, split, training
from fedspark.sources import files

from .test_core_parts import made, probs


def plain(x, y, clients, plan, weights=None, seed=7, client_of=None, batches=None):
    """An experiment by loops: clients hold arrays of rows."""
    full = np.hstack([x, x * x]) if plan.squares else x
    w, taken = np.zeros((3, full.shape[1])), [0] * plan.clients
    for r in range(plan.rounds):
        local = []
        for k, rows in enumerate(clients):
            own, m, v, t = w.copy(), 0.0, 0.0, 0
            for e in range(plan.epochs):
                for some in batches(r, e, k) if batches else [rows]:
                    a, b = full[some], y[some]
                    each = (probs(a, own) - np.eye(3)[b]) * (np.ones(len(b)) if weights is None else weights[k][b])[:, None]
                    if plan.clip:
                        norm = np.sqrt((each**2).sum(1) * (a**2).sum(1))
                        each = each * np.minimum(1, plan.clip / norm)[:, None]
                    g = each.T @ a
                    if plan.sigma:
                        g = g + plan.sigma * plan.clip * np.array([[gauss_of(seed, f"{taken[k]}_{k}_{c}_{j}") for j in range(g.shape[1])] for c in range(3)])
                        taken[k] += 1
                    g = g / (len(b) if plan.sigma or weights is None else weights[k][b].sum()) + plan.decay * own
                    if plan.adam:
                        t, m, v = t + 1, 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                        own = own - plan.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
                    else:
                        own = own - plan.rate * g
            local.append(own)
        n = np.array([len(c) for c in clients])
        w = sum(a * k for a, k in zip(local, n)) / n.sum()
    return w


def test_experiments_in_the_same_scans_equal_separate_loops(spark):
    rows, x, y = made(spark, 180)
    plans = [
        training.Experiment("central", epochs=4), training.Experiment("fed", 3, 0.5, 2, 3), training.Experiment("one", 3, 0.5, 3, 1), training.Experiment("other", 2, 5.0, 2, 2, squares=True),
        training.Experiment("private", 1, epochs=3, sigma=0.8, clip=0.5), training.Experiment("private clients", 3, 0.5, 2, 2, sigma=1.1, clip=0.3, adam=False, rate=0.5),
    ]
    dealt = training.deal(rows, plans, 3)
    at = training.offsets(plans)
    units = {r.id: list(r.units) for r in dealt.collect()}
    assert len(units) == 180 and at[-1] == 13
    same = {r.id: r.client for r in split.dirichlet_partition(rows, 3, 3, 0.5).collect()}
    assert all(u[1] - at[1] == u[2] - at[2] == same[i] for i, u in units.items())
    weights = training.label_weights(dealt, 13, 3)
    trainer = training.Trainer(plans, 3, 4, seed=7, weights=weights)
    state = trainer.train(files.written(dealt.select("features", "label", "units")))
    for k, plan in enumerate(plans):
        clients = [np.array([i for i in range(180) if units[i][k] == at[k] + c], int) for c in range(plan.clients)]
        for c, own in enumerate(clients):
            n = np.bincount(y[own], minlength=3)
            assert np.allclose(weights[at[k] + c], [len(own) / ((n > 0).sum() * v) if v else 1 for v in n])
        assert np.allclose(trainer.weights_of(k), plain(x, y, clients, plan, weights[at[k] :])), plan.name
    ledger = {(x["experiment"], x["round"], x["client"]): (x["steps"], x["epsilon"]) for x in state.ledger}
    assert len(ledger) == 1 + 2 * 3 and ledger["private clients", 2, 1][0] == 4
    assert ledger["private clients", 2, 1][1] == pytest.approx(math.sqrt(2 * 4 * math.log(1e5)) / 1.1)
    spent = training.spent(training.ledger_table(spark, state.ledger)).collect()
    assert len(spent) == 3 and all(r.epsilon > 0 for r in spent)


def test_noise_needs_a_clip_and_comes_from_the_system(spark):
    with pytest.raises(ValueError, match="clip"):
        training.Trainer([training.Experiment("x", sigma=1.0)], 3, 4)
    a, b = (training.Trainer([training.Experiment("x", sigma=1.0, clip=1.0)], 3, 4).noise(0) for _ in "ab")
    assert not np.allclose(a, b)
    got = spark.range(3).select(hash_gauss(5, "id").alias("g")).collect()
    assert np.allclose([r.g for r in got], [gauss_of(5, i) for i in range(3)])


def test_training_ends_once_its_privacy_is_spent(spark):
    rows, *_ = made(spark, 90)
    plans = [training.Experiment("short", epochs=9, sigma=1.0, clip=1.0, most_epsilon=8.0), training.Experiment("free", epochs=4), training.Experiment("long", 2, rounds=3, epochs=2, sigma=1.0, clip=1.0)]
    trainer = training.Trainer(plans, 3, 4, seed=1)
    state = trainer.train(training.deal(rows, plans, 3))
    spent = [x["epsilon"] for x in state.epochs if x["experiment"] == "short"]
    assert len(spent) == 3 and spent[1] <= 8 < spent[2]  # sqrt(2 t ln 1e5)
    assert [x["round"] for x in state.epochs if x["experiment"] == "long"] == [1, 1, 2, 2, 3, 3]
    free = [x["loss"] for x in state.epochs if x["experiment"] == "free"]
    assert free[0] == pytest.approx(math.log(3)) and free == sorted(free, reverse=True) and training.epoch_table(spark, state.epochs).count() == 13


def test_mini_batches_equal_a_plain_loop_and_the_best_round_is_kept(spark):
    rows, x, y = made(spark, 150)
    parts = rows.withColumn("client", F.when(F.col("id") < 50, 0).otherwise(1))
    clients = [np.arange(50), np.arange(50, 150)]

    def batches(r, e, k):
        order = [v.id for v in rows.select("id", hash_hex(f"batch_{r}_{e}", "id").alias("h")).orderBy("h").collect()]
        own = np.array([i for i in order if i in set(clients[k].tolist())])
        return [own[a : a + 32] for a in range(0, len(own), 32)]

    plan = training.Experiment("x", 2, rounds=2, epochs=2)
    got, _ = federated.federated_adam(parts, 3, 4, 2, 2)
    assert np.allclose(got, plain(x, y, clients, plan, batches=batches))
    held, hx, hy = made(spark, 90, seed=4)
    best, history = federated.federated_adam(parts, 3, 4, 3, 1, batch=None, rate=0.5, validate=held)
    f1, every = [], []
    for r in range(1, 4):
        w = plain(x, y, clients, training.Experiment("x", 2, rounds=r, epochs=1, rate=0.5))
        pred = probs(hx, w).argmax(1)
        of = lambda c: 2 * ((pred == c) & (hy == c)).sum() / max((pred == c).sum() + (hy == c).sum(), 1)  # noqa: E731, B023
        f1.append(np.mean([of(c) for c in sorted(set(pred) | set(hy))]))
        every.append(w)
    assert np.allclose([h["f1"] for h in history], f1) and np.allclose(best, every[int(np.argmax(f1))])


def test_mini_batches_take_jobs_by_rows_and_not_by_batches(spark, monkeypatch):
    rows, x, y = made(spark, 600)
    parts = files.written(rows.withColumn("client", F.when(F.col("id") < 150, 0).otherwise(1)))
    clients = [np.arange(150), np.arange(150, 600)]
    orders = {r: [v.id for v in rows.select("id", hash_hex(f"batch_{r}_0", "id").alias("h")).orderBy("h").collect()] for r in range(2)}

    def batches(r, e, k):
        own = np.array([i for i in orders[r] if i in set(clients[k].tolist())])
        return [own[a : a + 4] for a in range(0, len(own), 4)]

    want, jobs = plain(x, y, clients, training.Experiment("x", 2, rounds=2), batches=batches), []
    for numbers in (4 << 20, 4 * 4 * 50):  # one leg, three legs of 50 batches
        monkeypatch.setattr(training, "LEG_NUMBERS", numbers)
        spark.sparkContext.setJobGroup(f"batches {numbers}", "")
        got, _ = federated.federated_adam(parts, 3, 4, 2, 1, batch=4)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"batches {numbers}")))
        assert np.allclose(got, want)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs[0] < jobs[1] < 80  # 226 batches of the larger client


@pytest.mark.parametrize("numbers", [2 * 32 * 8, 32 * 8])
def test_private_mini_batches_in_legs_or_jobs_of_their_own_equal_a_plain_loop(spark, monkeypatch, numbers):
    rows, x, y = made(spark, 150)
    monkeypatch.setattr(training, "LEG_NUMBERS", numbers)
    order = np.array([v.id for v in rows.select("id", hash_hex("batch_0_0", "id").alias("h")).orderBy("h").collect()])
    plan = training.Experiment("x", 1, sigma=0.9, clip=0.4, batch=32, squares=True, decay=0.0)
    trainer = training.Trainer([plan], 3, 4, seed=7)
    state = trainer.train(rows.withColumn("units", F.array(F.lit(0))))
    want = plain(x, y, [np.arange(150)], plan, batches=lambda r, e, k: [order[a : a + 32] for a in range(0, 150, 32)])
    assert np.allclose(trainer.weights_of(0), want) and state.private_steps.tolist() == [5]


def test_a_cut_run_goes_on_from_its_last_whole_round(spark, tmp_path):
    rows, *_ = made(spark, 120)
    plans = [training.Experiment("a", 3, rounds=4, epochs=2, sigma=0.5, clip=1.0), training.Experiment("b", 2, rounds=3, epochs=1)]
    dealt = files.written(training.deal(rows, plans, 3).select("features", "label", "units"))
    figure = lambda k, w: float(w.sum() ** 2 % 1)
    new = lambda: training.Trainer(plans, 3, 4, seed=3)
    whole = new()
    whole.train(dealt, figure)
    folder, first = f"file://{tmp_path}/rounds", new()

    def after_round(trainer):
        training.save_round(spark, trainer.state, folder)
        return sum(trainer.state.round) >= 4

    first.train(dealt, figure, after_round)
    (tmp_path / "rounds" / "after=9").mkdir()  # a state that was never committed
    again = new()
    assert training.load_round(again, spark, folder) and 4 <= sum(again.state.round) < 7
    again.train(dealt, figure)
    for k in range(2):
        assert np.allclose(again.weights_of(k), whole.weights_of(k))
    assert again.state.ledger == whole.state.ledger and again.state.history == whole.state.history
    assert [(x["experiment"], x["round"], x["epoch"]) for x in again.state.epochs] == [(x["experiment"], x["round"], x["epoch"]) for x in whole.state.epochs]
    assert not training.load_round(new(), spark, f"file://{tmp_path}/none")


def test_a_sweep_measures_each_experiment_and_keeps_failures(spark):
    rows, x, y = made(spark, 300)
    configs = [("good", "central", "resnet50", 0.5, 1, 1, 30), ("squares", "federated", "vgg19", 0.5, 2, 6, 3), ("e1", "federated", "resnet50", 0.5, 3, 4, 1), ("e5", "federated", "resnet50", 0.5, 3, 4, 5), ("bad", "none", "resnet50", 0.5, 1, 1, 1), ("worse", "federated", "resnet50", -1.0, 2, 1, 1)]
    out = experiment.sweep(rows, configs, 3, 4, seed=1)
    got = {r.experiment: r for r in out.collect()}
    assert len(got) == 6 and set(got["good"].metrics) == set(experiment.FIGURES)
    assert got["good"].metrics["accuracy"] > 0.6 and got["e1"].metrics != got["e5"].metrics
    assert "no such setting" in got["bad"].error and "alpha" in got["worse"].error and got["bad"].metrics is None
    shown = {r.experiment: r for r in report.ablation_table(out).collect()}
    assert shown["bad"].failed and shown["bad"].accuracy == "0.0%" and not shown["good"].failed


def test_measures_by_experiment_equal_those_of_each_alone(spark):
    from fedspark.operators import privacy

    rng = np.random.default_rng(8)
    data = []
    for i in range(400):
        p = rng.dirichlet([1, 1, 1]).round(3).tolist()
        data.append(("ab"[i % 2], "train" if i % 3 else "test", int(rng.integers(0, 3)), p, int(np.argmax(p)), float(max(p))))
    scored = spark.createDataFrame(data, "experiment string, split string, label int, probs array<double>, pred int, confidence double")
    for r in experiment.measured(scored, 3).collect():
        own = scored.filter(F.col("experiment") == r.experiment)
        test = own.filter("split = 'test'")
        alone = metrics.macro(test, 3).first().asDict() | {"auroc_macro": metrics.auroc_macro(metrics.one_vs_rest(test)).first()[0]}
        attack = privacy.best_attack(privacy.attack_sweep(own.select("confidence", F.when(F.col("split") == "train", 1).otherwise(0).alias("member")))).first()
        alone |= {"mia_accuracy": attack.accuracy_pct, "mia_advantage": attack.advantage_pct}
        assert r.asDict() == pytest.approx(alone | {"experiment": r.experiment})
