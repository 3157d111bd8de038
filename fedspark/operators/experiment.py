"""Configured experiments: deal, train, score the test rows, measure and attack, all experiments in the same scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import remove, written
from . import metrics, privacy, split, training

#: Models by the names of experiments: the features as they are, or with their squares beside them.
MODELS = {"resnet50": False, "vgg19": True}
SETTINGS = ("federated", "private", "central")
FIGURES = ("accuracy", "precision_macro", "recall_macro", "f1_macro", "auroc_macro", "mia_accuracy", "mia_advantage")


def configured(name: str, setting: str, kind: str, alpha: float, clients: int, rounds: int, epochs: int, sigma: float = 1.1, clip: float = 1.0, **more) -> training.Experiment:
    """An experiment by its setting: clients' rounds, all rows in one place, or the same by clipped and noisy sums."""
    if setting not in SETTINGS:
        raise ValueError(f"no such setting: {setting}")
    if kind not in MODELS:
        raise ValueError(f"no such model: {kind}")
    if setting != "federated" and clients != 1:
        raise ValueError(f"{setting} training has one place, not {clients}")
    private = {"sigma": sigma, "clip": clip} if setting == "private" else {}
    made = training.Experiment(name, clients, alpha, rounds, epochs, MODELS[kind], **private, **more)
    if made.fault():
        raise ValueError(made.fault())
    return made


def with_model(rows: DataFrame, kind: str) -> DataFrame:
    """Rows with the features that a model sees."""
    return rows.withColumn("features", F.concat("features", F.transform("features", lambda v: v * v))) if MODELS[kind] else rows


def measured(scored: DataFrame, classes: int) -> DataFrame:
    """(experiment, FIGURES) from scored rows (experiment, split, label, probs, pred, confidence): metrics of test rows, and
    the attack that tells train from test rows by confidence."""
    test, key = scored.filter("split = 'test'"), ("experiment",)
    attack = privacy.attack_sweep(scored.select("experiment", "confidence", F.when(F.col("split") == "train", 1).otherwise(0).alias("member")), key)
    best = privacy.best_attack(attack, key).select("experiment", F.col("accuracy_pct").alias("mia_accuracy"), F.col("advantage_pct").alias("mia_advantage"))
    auroc = metrics.auroc_macro(metrics.one_vs_rest(test, key), key)
    return metrics.macro_by(test, classes, key).join(auroc, "experiment").join(best, "experiment").select("experiment", *FIGURES)


def sweep(rows: DataFrame, configs, classes: int, width: int, seed: int | None = None) -> DataFrame:
    """(experiment, metrics, error) for every configuration (see configured()) over rows (id, features, label).

    80 % of the rows train, 10 % test, the rest stays out. Rows are dealt out in all ways at once and written; then each
    step is one scan for all experiments, so the jobs are as many as the longest experiment has steps, however many
    experiments there are. An epoch of a client is one full-batch step, its loss weighed by the classes of all rows. A
    configuration that can't run, or whose weights don't stay finite, is a row with its error; a null seed draws private noise from the system.
    """
    spark, plans, errors = rows.sparkSession, [], {}
    for name, *rest in configs:
        try:
            plans.append(configured(name, *rest))
        except (TypeError, ValueError) as error:
            errors[name] = str(error)
    found = {}
    if plans:
        sides = split.split_by_cuts(rows.select("id", "features", "label"), [("train", 0.8), ("val", 0.9)], "test")
        sides = written(sides.filter("split <> 'val'"))
        train = written(training.deal(sides.filter("split = 'train'").select("id", "features", "label"), plans, classes).select("features", "label", "units"))
        units = training.offsets(plans)[-1]
        alike = training.label_weights(rows.select("label", F.array(F.lit(0)).alias("units")), 1, classes).repeat(units, 0)
        trainer = training.Trainer(plans, classes, width, seed, alike)
        state = trainer.train(train)
        for k, plan in enumerate(plans):
            if not (abs(trainer.weights_of(k)) < float("inf")).all():
                errors[plan.name] = "its weights are not finite"
                state.w[trainer.at[k] : trainer.at[k + 1]] = 0
        scored = written(training.score_all(sides, trainer, ("label", "split")))
        found = {r["experiment"]: r.asDict() for r in measured(scored, classes).collect()}  # a row for each experiment
        for own in (scored, train, sides):
            remove(own)
    out = [(name, None if name in errors else {k: float(found[name][k]) for k in FIGURES}, errors.get(name)) for name, *_ in configs]
    return spark.createDataFrame(out, "experiment string, metrics map<string,double>, error string")
