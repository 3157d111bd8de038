"""The convolutional network and expected gradients against finite differences and what they must add up to."""

import numpy as np
import pytest

from fedspark.operators import conv, explain



def loss(net, x, y):
    z, *_ = net.forward(x)
    return -np.log(conv.softmax(z)[np.arange(len(y)), y]).sum()


@pytest.fixture(scope="module")
def net():
    return conv.drawn_net((2, 4, 6), (3, 4), (2, 1), 3)


def test_patches_have_an_adjoint():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2, 3, 5, 4))
    c = rng.normal(size=conv.patches(x, 3).shape)
    assert (conv.patches(x, 3) * c).sum() == pytest.approx((x * conv.unpatch(c, 3, 5, 4, 3)).sum())


def test_gradients_by_finite_differences(net):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(5, 2, 4, 6)), rng.integers(0, 3, 5)
    z, seen, acts = net.forward(x)
    p = conv.softmax(z)
    p[np.arange(5), y] -= 1
    by_input, by_params = net.backward(p, seen, acts)
    flat = net.flat()
    for at in rng.choice(flat.size, 40, replace=False):
        step = np.zeros_like(flat)
        step[at] = 1e-6
        assert (loss(net.with_flat(flat + step), x, y) - loss(net.with_flat(flat - step), x, y)) / 2e-6 == pytest.approx(by_params[at], abs=1e-5)
    for at in list(np.ndindex(*x.shape))[::17]:
        step = np.zeros_like(x)
        step[at] = 1e-6
        assert (loss(net, x + step, y) - loss(net, x - step, y)) / 2e-6 == pytest.approx(by_input[at], abs=1e-5)
    hidden, _ = net.backward(p, seen, acts, 0)  # by the first layer's activations
    assert hidden.shape == acts[0].shape
    rest = conv.ConvNet((3, 2, 3), net.kernels[1:], net.biases[1:], net.pools[1:], net.head, net.bias)
    for at in list(np.ndindex(*acts[0].shape))[::23]:
        step = np.zeros_like(acts[0])
        step[at] = 1e-6
        pooled = lambda a: a.reshape(5, 3, 2, 2, 3, 2).mean((3, 5))
        assert (loss(rest, pooled(acts[0] + step), y) - loss(rest, pooled(acts[0] - step), y)) / 2e-6 == pytest.approx(hidden[at], abs=1e-5)


def test_maps_of_a_chosen_class(spark, net):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 48))
    rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "id long, features array<double>, label int")
    own = conv.class_maps(rows, net)
    scored = {r.id: r for r in conv.score(rows, net).collect()}
    for r in own.collect():
        assert r.target == scored[r.id].pred and r.confidence == pytest.approx(scored[r.id].confidence) and len(r.heat) == 24
        assert r.heat is None or (min(r.heat) >= 0 and max(r.heat) in (0.0, pytest.approx(1.0)))
    for r in conv.class_maps(rows, net, 0, target=2).collect():
        assert r.target == 2 and r.confidence == pytest.approx(scored[r.id].probs[2])
    flat = conv.ConvNet((1, 2, 2), (np.zeros((1, 1, 1, 1)),), (np.ones(1),), (1,), np.ones((2, 1)), np.zeros(2))
    one = spark.createDataFrame([(1, [0.0] * 4)], "id long, features array<double>")
    assert conv.class_maps(one, flat).first().heat is None  # a constant positive map
    assert conv.class_maps(one.limit(0), flat).count() == 0


def test_training_tells_stripes_apart(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 90)
    stripes = np.stack([np.tile([[1.0], [-1.0]], (2, 4)), np.tile([[1.0, -1.0]], (4, 2)), np.zeros((4, 4))])
    x = (stripes[y] + 0.3 * rng.normal(size=(90, 4, 4))).reshape(90, 16)
    rows = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(90)], "id long, features array<double>, label int").repartition(2)
    net, losses = conv.fit(rows, conv.drawn_net((1, 4, 4), (6,), (1,), 3), 25, rate=0.05)
    assert losses[-1] < losses[0] / 2
    assert np.mean([r.pred == r.label for r in conv.score(rows, net).collect()]) > 0.9


def test_expected_gradients(spark, net):
    rng = np.random.default_rng(4)
    make = lambda n, first: spark.createDataFrame([(first + i, rng.normal(size=48).tolist()) for i in range(n)], "id long, features array<double>")
    rows, back = make(6, 0), make(5, 100)
    x, b = (np.array([r.features for r in d.orderBy("id").collect()]) for d in (rows, back))
    w = rng.normal(size=(3, 96))
    linear = np.hstack([w[:, :48], np.zeros((3, 48))])
    of = lambda df: np.array([r.phi for r in df.orderBy("id", "c").collect()]).reshape(6, 3, 48)
    assert np.allclose(of(explain.expected_gradients(rows, back, explain.square_gradient(linear))), linear[None, :, :48] * (x - b.mean(0))[:, None])
    score = lambda v: v @ w[:, :48].T + (v * v) @ w[:, 48:].T
    many = of(explain.expected_gradients(rows.repartition(3), back, explain.square_gradient(w), paths=200)).sum(2)
    assert np.allclose(many, score(x) - score(b).mean(0), atol=0.05)
    logits = lambda v: net.forward(v.reshape(-1, *net.shape))[0]
    own = of(explain.expected_gradients(rows, back, conv.input_gradient(net), paths=100)).sum(2)
    assert np.allclose(own, logits(x) - logits(b).mean(0), atol=0.01)
    with pytest.raises(ValueError):
        explain.expected_gradients(rows, back.limit(0), explain.square_gradient(w))
