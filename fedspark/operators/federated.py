"""Federated averaging: clients' updates are computed where their rows are, and only parameters travel."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import training
from .model import gradients, score


def fedavg(client_params: DataFrame) -> DataFrame:
    """Clients' parameters (client, c, j, w, n), averaged by their numbers of rows."""
    return client_params.groupBy("c", "j").agg((F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("w"))


def client_step(rows: DataFrame, w: np.ndarray, rate: float) -> DataFrame:
    """Each client's parameters after one full-batch step (client, c, j, w, n), and its loss."""
    g = gradients(rows, w, ["client"])
    flat = F.array(*(F.lit(float(x)) for x in w.ravel()))
    start = F.element_at(flat, F.col("c") * w.shape[1] + F.col("j") + 1)
    return g.select("client", "c", "j", (start - rate * F.col("g") / F.col("n")).alias("w"), F.col("n").cast("long").alias("n"), (F.col("loss") / F.col("n")).alias("loss"))


def federated_rounds(rows: DataFrame, classes: int, width: int, rounds: int, rate: float = 1.0) -> np.ndarray:
    """Rounds of one full-batch step for each client and a weighted average. A round brings classes * width numbers to the driver."""
    w = np.zeros((classes, width))
    for _ in range(rounds):
        after = np.zeros_like(w)
        for r in fedavg(client_step(rows, w, rate)).collect():
            after[r["c"], r["j"]] = r["w"]
        w = after
    return w


def federated_adam(rows: DataFrame, classes: int, width: int, rounds: int, epochs: int, batch: int | None = 32, rate: float = 1e-2, validate: DataFrame | None = None) -> tuple[np.ndarray, list[dict]]:
    """Rounds of local Adam and averaging, over rows (id, features, label, client) with clients from 0 on.

    A client's epoch is one step for each batch of its own shuffle: a client of any size trains by one definition. Some
    thousands of batches (4 million features of a client) are one job, in which a task makes a client's steps one after
    another; larger batches are a job each, whose gradient is summed where its rows are. With validate, the best round by macro F1 on it wins, and it must
    be neither train nor test rows.
    """
    from .metrics import macro_f1

    clients = (rows.agg(F.max("client")).first()[0] or 0) + 1
    plan = training.Experiment("federated", clients, rounds=rounds, epochs=epochs, batch=batch, rate=rate)
    trainer = training.Trainer([plan], classes, width)
    figure = (lambda _, w: macro_f1(score(validate, w))) if validate is not None else None
    state = trainer.train(rows.withColumn("units", F.array(F.col("client").cast("int"))), figure)
    return trainer.weights_of(0), [{"round": h["round"], "f1": h["f1"]} for h in state.history]


def client_metrics(scored: DataFrame) -> DataFrame:
    """Each client's rows, mean loss and accuracy in percent."""
    own = F.element_at("probs", F.col("label") + 1)
    return scored.groupBy("client").agg(F.count(F.lit(1)).alias("n"), F.avg(-F.log(own)).alias("loss"), (F.avg(F.when(F.col("pred") == F.col("label"), 1.0).otherwise(0.0)) * 100).alias("accuracy_pct"))

