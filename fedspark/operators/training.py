"""Training of many models at once: every step is one scan of the rows, whose gradients have the model as leading axis.

An experiment has clients, each with weights of its own between two averages: a *unit*. All units of all experiments stand
in one array (units, classes, width), and a step computes the gradients of all units that still train in a single pass
over the rows, which never move. What comes to the driver are classes * width sums for each unit. Steps of small batches
are made many in a job, each unit's in one task, as every step needs the one before.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import gauss_of
from ..functions.ranking import hash_rank
from ..sources.files import remove, written
from .model import matrix
from .split import deal_many

RATE, DECAY = 1e-2, 1e-4
#: Features that a unit's batches of one job hold at most.
LEG_NUMBERS = 4 << 20


@dataclass(frozen=True)
class Experiment:
    """Rounds of local epochs on clients that a Dirichlet draw deals out, and averages between them.

    An epoch is one step on all rows of a client, or with `batch` one for each batch of its shuffle. With `sigma`, a step
    takes rows' gradients clipped to a norm of `clip` and adds Gaussian noise of sigma * clip to their sum; it ends after the
    first epoch in which some client has spent more than `most_epsilon`.
    """

    name: str
    clients: int = 1
    alpha: float = 0.5
    rounds: int = 1
    epochs: int = 1
    squares: bool = False
    sigma: float = 0.0
    clip: float | None = None
    most_epsilon: float | None = None
    batch: int | None = None
    adam: bool = True
    rate: float = RATE
    decay: float = DECAY

    def fault(self) -> str | None:
        """Why it can't run."""
        if min(self.clients, self.rounds, self.epochs) < 1 or self.batch is not None and self.batch < 1:
            return "clients, rounds, epochs and batches must be at least 1"
        if not self.alpha > 0:
            return "alpha must be above 0"
        if self.sigma and not self.clip:
            return "noise needs a norm to clip to: without it a step isn't private"
        return None


@dataclass
class State:
    """Weights, Adam's moments and steps of every unit, and how far each experiment has come."""

    w: np.ndarray
    m: np.ndarray
    v: np.ndarray
    steps: np.ndarray
    private_steps: np.ndarray
    round: list[int]
    epoch: list[int]
    best: list[np.ndarray | None] = field(default_factory=list)
    best_f1: list[float] = field(default_factory=list)
    history: list[dict] = field(default_factory=list)
    ledger: list[dict] = field(default_factory=list)
    epochs: list[dict] = field(default_factory=list)


def offsets(experiments: list[Experiment]) -> list[int]:
    """The first unit of each experiment, and the number of all."""
    return np.concatenate(([0], np.cumsum([e.clients for e in experiments]))).astype(int).tolist()


def deal(rows: DataFrame, experiments: list[Experiment], classes: int, seed: int = 42) -> DataFrame:
    """Rows (id, features, label) with `units`: the unit that each has in every experiment. Rows are ranked once for all."""
    ways = sorted({(e.alpha, e.clients) for e in experiments if e.clients > 1})
    at = offsets(experiments)
    if not ways:
        return rows.withColumn("units", F.array(*(F.lit(a) for a in at[:-1])))
    dealt = deal_many(rows, classes, ways, seed, name="_dealt")
    unit = lambda k, e: F.lit(at[k]) if e.clients == 1 else F.lit(at[k]) + F.col("_dealt")[ways.index((e.alpha, e.clients))]
    return dealt.withColumn("units", F.array(*(unit(k, e) for k, e in enumerate(experiments)))).drop("_dealt")


def with_squares(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, x * x])


def gradient(x: np.ndarray, labels: np.ndarray, w: np.ndarray, clip: float, weights: np.ndarray | None, more: np.ndarray) -> np.ndarray:
    """The sum of the rows' gradients, each clipped first if clip is finite; their loss, weights and number are added to more."""
    z = x @ w.T
    z -= z.max(1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(1, keepdims=True)
    at = np.arange(len(x))
    weight = np.ones(len(x)) if weights is None else weights[labels]
    more += (-np.log(p[at, labels]) * weight).sum(), weight.sum(), len(x)
    p[at, labels] -= 1
    p *= weight[:, None]
    if np.isfinite(clip):
        norm = np.sqrt((p * p).sum(1)) * np.sqrt((x * x).sum(1))
        p *= np.minimum(1.0, clip / np.maximum(norm, 1e-300))[:, None]
    return p.T @ x


def unit_gradients(rows: DataFrame, w: np.ndarray, active: np.ndarray, widths: np.ndarray, clips: np.ndarray, weights: np.ndarray | None = None) -> dict[int, tuple[np.ndarray, float, float, int]]:
    """Of each active unit that has rows: the sum of its rows' gradients, of their loss, of their weights, and their number.

    Only the first `widths` of a unit's features count; a width beyond the features' takes their squares. A unit with a
    finite clip scales each row's gradient to that norm first. weights (units, classes) weigh a row by its label; rows
    without one add nothing.
    """
    units, classes, width = w.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, more = np.zeros_like(w), np.zeros((units, 3))
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch.column("features"))
            x = with_squares(x) if width > x.shape[1] else x
            y = batch.column("label").to_numpy()
            dealt = batch.column("units").flatten().to_numpy().reshape(len(batch), -1)
            for of in dealt.T:
                order = np.argsort(of, kind="stable")
                edges = np.flatnonzero(np.diff(of[order])) + 1
                for on in np.split(order, edges):
                    u = of[on[0]]
                    if u < 0 or not active[u]:
                        continue
                    sums[u, :, : widths[u]] += gradient(x[on, : widths[u]], y[on], w[u, :, : widths[u]], clips[u], None if weights is None else weights[u], more[u])
        used = np.flatnonzero(more[:, 2])
        cells = classes * width
        flat = np.concatenate([sums[used].reshape(len(used), cells), more[used]], 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, cells + 3).astype(np.int32)), pa.array(np.tile(np.arange(cells + 3), len(used)).astype(np.int32)), pa.array(flat.ravel())], names=["unit", "at", "g"])

    sent = rows.filter("label is not null").select("features", "label", "units").mapInArrow(run, "unit int, at int, g double").groupBy("unit", "at").agg(F.sum("g").alias("g")).toArrow()
    flat = np.zeros((units, classes * width + 3))
    flat[sent.column("unit").to_numpy(), sent.column("at").to_numpy()] = sent.column("g").to_numpy()
    return {int(u): (flat[u, :-3].reshape(classes, width), flat[u, -3], flat[u, -2], int(flat[u, -1])) for u in np.flatnonzero(flat[:, -1])}


def label_weights(rows: DataFrame, units: int, classes: int) -> np.ndarray:
    """(units, classes): each unit's own weights, its rows over present classes times the class's rows; absent ones have 1."""
    counts = rows.select("label", F.explode("units").alias("unit")).filter("unit >= 0").groupBy("unit", "label").agg(F.count(F.lit(1)).alias("n")).collect()
    n = np.zeros((units, classes))
    for r in counts:
        n[r["unit"], r["label"]] = r["n"]
    present = np.maximum((n > 0).sum(1, keepdims=True), 1)
    return np.where(n > 0, n.sum(1, keepdims=True) / (present * np.maximum(n, 1)), 1.0)


def epoch_batches(rows: DataFrame, batch: int, seed: str) -> tuple[DataFrame, int]:
    """Rows (units of one experiment) with their batch in their unit's shuffle for this epoch, and the most batches of a unit."""
    keyed = rows.withColumn("_unit", F.col("units")[0])
    ranked = hash_rank(keyed, seed, keys=("_unit",)).withColumn("batch", F.expr(f"(rn - 1) div {batch}"))
    most = keyed.groupBy("_unit").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    return ranked.select("features", "label", "units", "batch"), -(-most // batch)


class Trainer:
    """Runs experiments over dealt rows. `noise` gives a private step's standard normal numbers by unit, step and shape;
    without one they come from the system's generator. A seed draws them from hashes, for tests: that gives no privacy."""

    def __init__(self, experiments: list[Experiment], classes: int, width: int, seed: int | None = None, weights: np.ndarray | None = None, delta: float = 1e-5):
        faults = [f"{e.name}: {e.fault()}" for e in experiments if e.fault()]
        if faults:
            raise ValueError("; ".join(faults))
        if any(e.batch for e in experiments) and len(experiments) > 1:
            raise ValueError("experiments with batches have steps of their own: train each alone")
        self.experiments, self.at, self.classes, self.width, self.seed, self.weights, self.delta = experiments, offsets(experiments), classes, width, seed, weights, delta
        full = width * (2 if any(e.squares for e in experiments) else 1)
        self.of = np.repeat(np.arange(len(experiments)), [e.clients for e in experiments])
        self.widths = np.array([width * (2 if experiments[k].squares else 1) for k in self.of])
        self.clips = np.array([experiments[k].clip or math.inf for k in self.of])
        shape = (self.at[-1], classes, full)
        n = len(experiments)
        self.state = State(np.zeros(shape), np.zeros(shape), np.zeros(shape), np.zeros(shape[0], int), np.zeros(shape[0], int), [0] * n, [0] * n, [None] * n, [0.0] * n)
        self.rng = np.random.default_rng()

    def noise(self, unit: int) -> np.ndarray:
        shape = self.state.w.shape[1:]
        if self.seed is None:
            return self.rng.standard_normal(shape)
        client, step = unit - self.at[self.of[unit]], self.state.private_steps[unit]
        return np.array([[gauss_of(self.seed, f"{step}_{client}_{c}_{j}") for j in range(shape[1])] for c in range(shape[0])])

    def move(self, u: int, g: np.ndarray, weight: float, n: int) -> None:
        """Unit u's step by the sum of its rows' gradients, with their weights and their number."""
        s, e = self.state, self.experiments[self.of[u]]
        if e.sigma:
            g = g + self.noise(u) * (e.sigma * e.clip)
            s.private_steps[u] += 1
        g = g / max(n if e.sigma else weight, 1e-300)
        g[:, self.widths[u] :] = 0
        g[:, : self.widths[u]] += e.decay * s.w[u, :, : self.widths[u]]
        s.steps[u] += 1
        if not e.adam:
            s.w[u] -= e.rate * g
            return
        t = int(s.steps[u])
        s.m[u], s.v[u] = 0.9 * s.m[u] + 0.1 * g, 0.999 * s.v[u] + 0.001 * g * g
        s.w[u] -= e.rate * (s.m[u] / (1 - 0.9**t)) / (np.sqrt(s.v[u] / (1 - 0.999**t)) + 1e-8)

    def step(self, rows: DataFrame, active: np.ndarray) -> dict[int, tuple]:
        """One step of every active unit that has rows."""
        found = unit_gradients(rows, self.state.w, active, self.widths, self.clips, self.weights)
        for u, (g, _, weight, n) in found.items():
            self.move(u, g, weight, n)
        return found

    def leg(self, rows: DataFrame) -> dict[int, tuple]:
        """One step for each batch of rows (features, label, units, batch) in every unit of the one experiment, in batches'
        order: a task makes all steps of a unit, since each needs the weights of the one before."""
        s, full, kept = self.state, self.state.w.shape[2], ("w", "m", "v")

        def run(group: pa.Table) -> pa.Table:
            u = group.column("unit")[0].as_py()
            self.rng = np.random.default_rng()
            group, more = group.sort_by("batch").combine_chunks(), np.zeros(3)
            x, y = matrix(group.column("features").chunk(0)), group.column("label").to_numpy()
            x = with_squares(x) if full > x.shape[1] else x
            edges = np.flatnonzero(np.diff(group.column("batch").to_numpy(), prepend=-1, append=-1))
            for a, b in zip(edges[:-1], edges[1:]):
                own, g = np.zeros(3), np.zeros(self.state.w.shape[1:])
                g[:, : self.widths[u]] = gradient(x[a:b, : self.widths[u]], y[a:b], self.state.w[u, :, : self.widths[u]], self.clips[u], None if self.weights is None else self.weights[u], own)
                self.move(u, g, own[1], int(own[2]))
                more += own
            after = [*(pa.array([getattr(self.state, k)[u].ravel()]) for k in kept), pa.array([more]), pa.array([[self.state.steps[u], self.state.private_steps[u]]])]
            return pa.table([pa.array([u], pa.int32()), *after], names=["unit", *kept, "more", "steps"])

        rows = rows.filter("label is not null").select(F.col("units")[0].alias("unit"), "batch", "features", "label").filter("unit >= 0")
        sent = rows.groupBy("unit").applyInArrow(run, "unit int, w array<double>, m array<double>, v array<double>, more array<double>, steps array<long>").toArrow().to_pylist()
        for r in sent:
            u = r["unit"]
            for k in kept:
                getattr(s, k)[u] = np.reshape(r[k], s.w.shape[1:])
            s.steps[u], s.private_steps[u] = r["steps"]
        return {r["unit"]: (None, *r["more"][:2], int(r["more"][2])) for r in sent}

    def epoch_in_batches(self, rows: DataFrame, batch: int, active: np.ndarray) -> list[dict[int, tuple]]:
        """An epoch of one step for each batch of a unit's shuffle. Its rows are written by batch, and a job takes a leg of
        so many batches as LEG_NUMBERS of a unit hold, and reads them alone; so no task holds more, and jobs grow with the
        largest unit's rows, not with its batches. Batches too large for that are a job each, summed where their rows are."""
        s = self.state
        dealt, most = epoch_batches(rows, batch, f"batch_{s.round[0]}_{s.epoch[0]}")
        dealt = written(dealt, "batch")
        batches = LEG_NUMBERS // (batch * s.w.shape[2])
        if batches < 2:
            found = [self.step(dealt.filter(F.col("batch") == b), active) for b in range(most)]
        else:
            found = [self.leg(dealt.filter(F.col("batch").between(b, b + batches - 1))) for b in range(0, most, batches)]
        remove(dealt)
        return found

    def average(self, k: int, sizes: np.ndarray) -> None:
        """Clients of experiment k get the mean of their weights by their rows, and a fresh optimiser."""
        s, own = self.state, slice(self.at[k], self.at[k + 1])
        n = sizes[own]
        if n.sum():
            s.w[own] = (s.w[own] * n[:, None, None]).sum(0) / n.sum()
        s.m[own], s.v[own], s.steps[own] = 0, 0, 0

    def epsilon(self, unit: int, n: int) -> float:
        """What the unit's steps so far have spent: its noisy steps compose over rounds."""
        e, t = self.experiments[self.of[unit]], int(self.state.private_steps[unit])
        q = min(1.0, e.batch / max(n, 1)) if e.batch else 1.0
        return q * math.sqrt(2 * t * math.log(1 / self.delta)) / e.sigma

    def train(self, rows: DataFrame, validate: Callable[[int, np.ndarray], float] | None = None, after_round: Callable[[Trainer], bool | None] | None = None) -> State:
        """All experiments to their end. Rows (features, label, units; id with batches) should be a written table.

        validate gives a figure for an experiment's averaged weights after each of its rounds: the first round of the best
        one above 0 is kept. after_round is called when some experiment has ended a round; where it returns True, training stops there.
        """
        s = self.state
        sizes = np.zeros(self.at[-1], int)
        counted = rows.select(F.explode("units").alias("unit")).groupBy("unit").agg(F.count(F.lit(1)).alias("n")).collect()
        for r in counted:
            if r["unit"] >= 0:
                sizes[r["unit"]] = r["n"]
        while any(r < e.rounds for r, e in zip(s.round, self.experiments)):
            going = np.array([r < e.rounds for r, e in zip(s.round, self.experiments)])
            active = going[self.of]
            if batch := self.experiments[0].batch:
                found = self.epoch_in_batches(rows, batch, active)
            else:
                found = [self.step(rows, active)]
            ended = False
            for k in np.flatnonzero(going):
                e, own = self.experiments[k], range(self.at[k], self.at[k + 1])
                s.epoch[k] += 1
                seen = [step[u] for step in found for u in own if u in step]
                spent = max((self.epsilon(u, int(sizes[u])) for u in own if sizes[u]), default=0.0) if e.sigma else None
                s.epochs.append({"experiment": e.name, "round": s.round[k] + 1, "epoch": s.epoch[k], "loss": float(sum(x[1] for x in seen) / max(sum(x[2] for x in seen), 1e-300)), "epsilon": spent})
                over = e.most_epsilon is not None and spent is not None and spent > e.most_epsilon
                if s.epoch[k] < e.epochs and not over:
                    continue
                self.average(k, sizes)
                s.epoch[k], s.round[k], ended = 0, e.rounds if over else s.round[k] + 1, True
                if e.sigma:
                    for u in own:
                        s.ledger.append({"experiment": e.name, "round": s.round[k], "client": u - self.at[k], "steps": int(s.private_steps[u]), "epsilon": self.epsilon(u, int(sizes[u])) if sizes[u] else 0.0})
                if validate:
                    w = s.w[self.at[k]]
                    figure = float(validate(int(k), w))
                    s.history.append({"experiment": e.name, "round": s.round[k], "f1": figure})
                    if figure > s.best_f1[k]:
                        s.best_f1[k], s.best[k] = figure, w.copy()
            if ended and after_round and after_round(self):
                break
        return s

    def weights_of(self, k: int) -> np.ndarray:
        """(classes, width): experiment k's weights, of its best round if rounds were validated."""
        best = self.state.best[k]
        return (self.state.w[self.at[k]] if best is None else best)[:, : self.widths[self.at[k]]]


def ledger_table(spark: SparkSession, ledger: list[dict]) -> DataFrame:
    return spark.createDataFrame([(x["experiment"], x["round"], x["client"], x["steps"], x["epsilon"]) for x in ledger], "experiment string, round int, client int, steps int, epsilon double")


def epoch_table(spark: SparkSession, epochs: list[dict]) -> DataFrame:
    """Each epoch's mean loss before its steps, and what has been spent after them."""
    return spark.createDataFrame([(x["experiment"], x["round"], x["epoch"], x["loss"], x["epsilon"]) for x in epochs], "experiment string, round int, epoch int, loss double, epsilon double")


def spent(ledger: DataFrame) -> DataFrame:
    """(experiment, round, epsilon) after each round: clients hold different rows, so the largest of theirs counts."""
    return ledger.groupBy("experiment", "round").agg(F.max("epsilon").alias("epsilon"))


# checkpoints of rounds

STATE = "round array<int>, epoch array<int>, w array<double>, m array<double>, v array<double>, steps array<int>, private_steps array<int>, best array<array<double>>, best_f1 array<double>, history array<struct<experiment:string,round:int,f1:double>>, ledger array<struct<experiment:string,round:int,client:int,steps:int,epsilon:double>>, epochs array<struct<experiment:string,round:int,epoch:int,loss:double,epsilon:double>>"


def save_round(spark: SparkSession, state: State, folder: str) -> None:
    """The state after a round, one row of one file, which stands there whole or not at all."""
    flat = lambda a: a.ravel().tolist()
    best = [None if b is None else flat(b) for b in state.best]
    row = (state.round, state.epoch, flat(state.w), flat(state.m), flat(state.v), state.steps.tolist(), state.private_steps.tolist(), best, state.best_f1, [(h["experiment"], h["round"], h["f1"]) for h in state.history], [(x["experiment"], x["round"], x["client"], x["steps"], x["epsilon"]) for x in state.ledger], [(x["experiment"], x["round"], x["epoch"], x["loss"], x["epsilon"]) for x in state.epochs])
    spark.createDataFrame([row], STATE).coalesce(1).write.mode("overwrite").parquet(f"{folder}/after={sum(state.round)}")


def load_round(trainer: Trainer, spark: SparkSession, folder: str) -> bool:
    """Takes up the last whole state below folder, if there is one. Folders without a mark of success are passed over."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in store.listStatus(where)] if store.exists(where) else []
    whole = [n for n in names if n.startswith("after=") and store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
    if not whole:
        return False
    r = spark.read.schema(STATE).parquet(f"{folder}/{max(whole, key=lambda n: int(n.partition('=')[2]))}").first()
    s, shape = trainer.state, trainer.state.w.shape
    s.w, s.m, s.v = (np.array(r[k]).reshape(shape) for k in "wmv")
    s.steps, s.private_steps, s.round, s.epoch = np.array(r["steps"]), np.array(r["private_steps"]), list(r["round"]), list(r["epoch"])
    s.best, s.best_f1 = [None if b is None else np.array(b).reshape(shape[1:]) for b in r["best"]], list(r["best_f1"])
    s.history, s.ledger = [h.asDict() for h in r["history"]], [x.asDict() for x in r["ledger"]]
    s.epochs = [x.asDict() for x in r["epochs"]]
    return True


# scoring by experiment


def score_all(rows: DataFrame, trainer: Trainer, keep: tuple[str, ...] = ("id", "label")) -> DataFrame:
    """A row for each row and experiment: keep, experiment, probs, pred (of logits to nine decimals, the first of equals) and confidence."""
    stack, names = [trainer.weights_of(k) for k in range(len(trainer.experiments))], [e.name for e in trainer.experiments]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = matrix(batch.column("features"))
            both = with_squares(x)
            for name, w in zip(names, stack):
                z = both[:, : w.shape[1]] @ w.T
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(w)), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([name] * len(x)), lists, pa.array(np.round(z, 9).argmax(1).astype(np.int32)), pa.array(p.max(1))], names=[*keep, "experiment", "probs", "pred", "confidence"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, "features").mapInArrow(run, f"{kinds}, experiment string, probs array<double>, pred int, confidence double")
