"""A small convolutional network in Arrow batches: scores, class-activation maps from its own gradients, and training.

A convolution is one matrix product over patches (im2col), and its backward pass the product's adjoint, so activations and
gradients at any layer, down to the input, are the model's own. Images never leave their partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import gauss_of
from .model import Adam, matrix
from .prep import bilinear_weights

#: Numbers that the patches of one step hold, about.
STEP_CELLS = 1 << 22


def patches(x: np.ndarray, k: int) -> np.ndarray:
    """(n, channels * k * k, height * width): what each place's kernel sees, zeros beyond the edge."""
    n, c, h, w = x.shape
    r = k // 2
    wide = np.pad(x, ((0, 0), (0, 0), (r, r), (r, r)))
    seen = np.lib.stride_tricks.sliding_window_view(wide, (k, k), axis=(2, 3))  # n, c, h, w, k, k
    return seen.transpose(0, 1, 4, 5, 2, 3).reshape(n, c * k * k, h * w)


def unpatch(columns: np.ndarray, c: int, h: int, w: int, k: int) -> np.ndarray:
    """The adjoint of patches(): every place gets the sum of what its patches hold of it."""
    n, r = len(columns), k // 2
    parts = columns.reshape(n, c, k, k, h, w)
    wide = np.zeros((n, c, h + 2 * r, w + 2 * r))
    for dy in range(k):
        for dx in range(k):
            wide[:, :, dy : dy + h, dx : dx + w] += parts[:, :, dy, dx]
    return wide[:, :, r : r + h, r : r + w]


@dataclass(frozen=True)
class ConvNet:
    """Layers of odd kernels (filters, channels, k, k), bias and ReLU, each followed by a mean over cells of `pools` to a side;
    then the mean over the image and a linear layer `head` (classes, filters). Images are (channels, height, width)."""

    shape: tuple[int, int, int]
    kernels: tuple[np.ndarray, ...]
    biases: tuple[np.ndarray, ...]
    pools: tuple[int, ...]
    head: np.ndarray
    bias: np.ndarray

    def sides(self) -> list[tuple[int, int]]:
        """Height and width of each layer's activations."""
        out, (h, w) = [], self.shape[1:]
        for p in self.pools:
            out.append((h, w))
            if h % p or w % p:
                raise ValueError(f"{h} x {w} activations can't be cut into cells of {p}")
            h, w = h // p, w // p
        return out

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in (*self.kernels, *self.biases, self.head, self.bias)])

    def with_flat(self, values: np.ndarray) -> ConvNet:
        parts, at = [], 0
        for a in (*self.kernels, *self.biases, self.head, self.bias):
            parts.append(values[at : at + a.size].reshape(a.shape))
            at += a.size
        n = len(self.kernels)
        return replace(self, kernels=tuple(parts[:n]), biases=tuple(parts[n : 2 * n]), head=parts[-2], bias=parts[-1])

    def rows_at_once(self) -> int:
        cells = max(k.shape[1] * k.shape[2] * k.shape[3] * h * w for k, (h, w) in zip(self.kernels, self.sides()))
        return max(1, STEP_CELLS // cells)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Logits of images (n, channels, height, width), and each layer's patches and activations."""
        seen, acts = [], []
        for kernel, bias, pool in zip(self.kernels, self.biases, self.pools):
            n, _, h, w = x.shape
            columns = patches(x, kernel.shape[2])
            act = np.maximum(kernel.reshape(len(kernel), -1) @ columns + bias[:, None], 0).reshape(n, len(kernel), h, w)
            seen.append(columns)
            acts.append(act)
            x = act.reshape(n, len(kernel), h // pool, pool, w // pool, pool).mean((3, 5)) if pool > 1 else act
        return x.mean((2, 3)) @ self.head.T + self.bias, seen, acts

    def backward(self, d: np.ndarray, seen: list[np.ndarray], acts: list[np.ndarray], to: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """For d, the loss's gradient by logits (n, classes): its gradient by the activations of layer `to` (the input: -1), for
        each image, and by all parameters that lie behind, summed over images (zeros before)."""
        last = acts[-1].shape
        pooled = acts[-1].reshape(*last[:2], last[2] // self.pools[-1], self.pools[-1], last[3] // self.pools[-1], self.pools[-1]).mean((3, 5))
        parts: list[np.ndarray] = [d.sum(0), d.T @ pooled.mean((2, 3))]  # from the last to the first
        g = np.broadcast_to((d @ self.head / (pooled.shape[2] * pooled.shape[3]))[:, :, None, None], pooled.shape)
        kernels, biases = [np.zeros_like(k) for k in self.kernels], [np.zeros_like(b) for b in self.biases]
        for layer in range(len(self.kernels) - 1, -1, -1):
            p = self.pools[layer]
            g = np.repeat(np.repeat(g, p, 2), p, 3) / (p * p) if p > 1 else g
            if layer == to:
                break
            kernel, act = self.kernels[layer], acts[layer]
            n, f, h, w = act.shape
            before = (g * (act > 0)).reshape(n, f, h * w)
            kernels[layer] = np.einsum("nfp,nkp->fk", before, seen[layer], optimize=True).reshape(kernel.shape)
            biases[layer] = before.sum((0, 2))
            g = unpatch(kernel.reshape(f, -1).T @ before, kernel.shape[1], h, w, kernel.shape[2])
        return np.ascontiguousarray(g), np.concatenate([a.ravel() for a in (*kernels, *biases, parts[1], parts[0])])


def drawn_net(shape: tuple[int, int, int], filters: tuple[int, ...], pools: tuple[int, ...], classes: int, k: int = 3, seed: str = "conv") -> ConvNet:
    """A network whose weights are drawn from hashes, scaled by the numbers that each sums."""
    draw = lambda name, *dims: np.array([gauss_of(seed, name + "".join(f"_{i}" for i in at)) for at in np.ndindex(*dims)]).reshape(dims)
    kernels, channels = [], shape[0]
    for n, f in enumerate(filters):
        kernels.append(draw(f"k{n}", f, channels, k, k) / np.sqrt(channels * k * k))
        channels = f
    return ConvNet(shape, tuple(kernels), tuple(np.zeros(f) for f in filters), pools, draw("head", classes, channels) / np.sqrt(channels), np.zeros(classes))


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _images(batch: pa.RecordBatch, net: ConvNet) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, images) in runs whose patches stay small."""
    step = net.rows_at_once()
    for at in range(0, len(batch), step):
        some = batch.slice(at, step)
        yield at, matrix(some.column("features")).reshape(len(some), *net.shape)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def score(rows: DataFrame, net: ConvNet) -> DataFrame:
    """id, label, logits, probs, pred (of logits to nine decimals, the first of equals) and confidence of each image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _images(batch, net):
                z, *_ = net.forward(x)
                p = softmax(z)
                some = batch.slice(at, len(x))
                yield pa.RecordBatch.from_arrays([some.column("id"), some.column("label"), _lists(z), _lists(p), pa.array(np.round(z, 9).argmax(1).astype(np.int32)), pa.array(p.max(1))], names=["id", "label", "logits", "probs", "pred", "confidence"])

    return rows.select(F.col("id").cast("long"), F.col("label").cast("int"), "features").mapInArrow(run, "id long, label int, logits array<double>, probs array<double>, pred int, confidence double")


def class_maps(rows: DataFrame, net: ConvNet, layer: int = -1, target: int | None = None) -> DataFrame:
    """(id, target, confidence, heat): where a layer's activations speak for a class, the target or else the predicted one.

    Channels are weighed by the mean gradient of the class's logit by them, summed, cut off below 0, brought to the image's
    size (bilinear) and to [0, 1] if the largest value is above 0; a constant positive map has no range and is null.
    confidence is the probability of the class.
    """
    layer = layer % len(net.kernels)
    h, w = net.sides()[layer]
    down, across = (np.array(bilinear_weights(a, b)) for a, b in ((h, net.shape[1]), (w, net.shape[2])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _images(batch, net):
                z, seen, acts = net.forward(x)
                p = softmax(z)
                c = np.round(z, 9).argmax(1) if target is None else np.full(len(x), target)
                g, _ = net.backward(np.eye(len(net.head))[c], seen, acts, layer)
                heat = np.maximum(np.einsum("nf,nfyx->nyx", g.mean((2, 3)), acts[layer]), 0)
                heat = down @ heat @ across.T
                low, high = heat.min((1, 2), keepdims=True), heat.max((1, 2), keepdims=True)
                flat = (high == low) & (high > 0)
                heat = np.where(high > 0, (heat - low) / np.where(high > low, high - low, 1), heat).reshape(len(x), -1)
                lists = _lists(heat)
                if flat.any():
                    lists = pa.ListArray.from_arrays(lists.offsets, lists.values, mask=pa.array(flat.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, len(x)), pa.array(c.astype(np.int32)), pa.array(p[np.arange(len(x)), c]), lists], names=["id", "target", "confidence", "heat"])

    return rows.select(F.col("id").cast("long"), "features").mapInArrow(run, "id long, target int, confidence double, heat array<double>")


def gradients(rows: DataFrame, net: ConvNet) -> tuple[np.ndarray, float, int]:
    """Sums over all rows of the cross-entropy's gradient by net.flat(), and of the loss; and the number of rows. A task sends
    one number a parameter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, more = np.zeros(net.flat().size), np.zeros(2)
        for batch in batches:
            for at, x in _images(batch, net):
                y = batch.column("label").slice(at, len(x)).to_numpy()
                z, seen, acts = net.forward(x)
                p = softmax(z)
                more += -np.log(p[np.arange(len(x)), y]).sum(), len(x)
                p[np.arange(len(x)), y] -= 1
                total += net.backward(p, seen, acts)[1]
        flat = np.concatenate([total, more])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["at", "g"])

    sent = rows.select("features", "label").mapInArrow(run, "at int, g double").groupBy("at").agg(F.sum("g").alias("g")).toArrow()
    flat = np.zeros(net.flat().size + 2)
    flat[sent.column("at").to_numpy()] = sent.column("g").to_numpy()
    return flat[:-2], float(flat[-2]), int(flat[-1])


def fit(rows: DataFrame, net: ConvNet, steps: int, rate: float = 1e-2, decay: float = 1e-4) -> tuple[ConvNet, list[float]]:
    """The network after full-batch steps of Adam, each one scan, and the mean loss before each. Rows should be a written table."""
    adam, losses = Adam(rate, decay), []
    for _ in range(steps):
        g, loss, n = gradients(rows, net)
        losses.append(loss / max(n, 1))
        net = net.with_flat(adam(net.flat(), g / max(n, 1)))
    return net, losses


def input_gradient(net: ConvNet):
    """For expected gradients: points (n, width) to the gradients of all logits by them (classes, n, width)."""

    def of(points: np.ndarray) -> np.ndarray:
        out = np.empty((len(net.head), *points.shape))
        step = net.rows_at_once()
        for at in range(0, len(points), step):
            x = points[at : at + step].reshape(-1, *net.shape)
            _, seen, acts = net.forward(x)
            for c in range(len(net.head)):
                out[c, at : at + step] = net.backward(np.eye(len(net.head))[[c] * len(x)], seen, acts)[0].reshape(len(x), -1)
        return out

    return of
