"""The learners of ops 6 and 8 against plain loops over the published update
rules (one weight at a time, no arrays)."""

import math
import random

import numpy as np
import pytest

from subscope.llm import linear

FEATURES, CLASSES, EPOCHS, SEED = 60, 3, 3, 7


def _examples(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for _ in range(n):
        c = rng.randrange(CLASSES)
        own = rng.sample(range(20 * c, 20 * c + 20), rng.randint(0, 6))
        noise = [f for f in rng.sample(range(FEATURES), 4) if f not in own]
        rows.append([(f, rng.random()) for f in own + noise])
        labels.append(c)
    return rows, labels


def _plain_ftrl(rows, labels, order, alpha, beta, l1, l2):
    z, n = {}, {}

    def weight(f, c):
        x = z.get((f, c), 0.0)
        if abs(x) <= l1:
            return 0.0
        return -(x - math.copysign(l1, x)) / ((beta + math.sqrt(n.get((f, c), 0.0))) / alpha + l2)

    for i in order:
        w = {(f, c): weight(f, c) for f, _ in rows[i] for c in range(CLASSES)}
        s = [sum(v * w[f, c] for f, v in rows[i]) for c in range(CLASSES)]
        e = [math.exp(x - max(s)) for x in s]
        for c in range(CLASSES):
            off = e[c] / sum(e) - (labels[i] == c)
            for f, v in rows[i]:
                g, old = v * off, n.get((f, c), 0.0)
                sigma = (math.sqrt(old + g * g) - math.sqrt(old)) / alpha
                z[f, c] = z.get((f, c), 0.0) + g - sigma * w[f, c]
                n[f, c] = old + g * g
    return [[weight(f, c) for c in range(CLASSES)] for f in range(FEATURES)]


def _as_rows(rows):
    return linear.rows_of([np.array([f for f, _ in r], np.int64) for r in rows], [np.array([v for _, v in r]) for r in rows])


@pytest.mark.parametrize("l1, l2", [(0.05, 0.05), (1.0, 1.0), (0.0, 0.0)])
@pytest.mark.parametrize("part", [False, True], ids=["all", "some"])
def test_ftrl_equals_a_plain_loop(l1, l2, part):
    rows, labels = _examples(200, 1)
    which = np.arange(0, 200, 3) if part else None
    got = linear.Ftrl(FEATURES, CLASSES, alpha=1.0, l1=l1, l2=l2).learn(
        _as_rows(rows), np.array(labels), EPOCHS, SEED, which=which).weights()
    rng = np.random.default_rng(SEED)
    order = [i for _ in range(EPOCHS) for i in rng.permutation(200 if which is None else which).tolist()]
    want = _plain_ftrl(rows, labels, order, 1.0, 1.0, l1, l2)
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-12)
    if l1:  # the penalty leaves weights at exactly zero
        assert (got == 0).sum() == sum(x == 0 for r in want for x in r) > 0


def test_scores_equal_a_plain_loop():
    rows, _ = _examples(50, 2)
    w = np.random.default_rng(3).normal(size=(FEATURES, CLASSES))
    want = [[sum(v * w[f, c] for f, v in r) for c in range(CLASSES)] for r in rows]
    np.testing.assert_allclose(linear.scores(_as_rows(rows), w), want, rtol=1e-12, atol=1e-12)
    np.testing.assert_allclose(linear.scores(_as_rows(rows), w, [4, 1]), [want[4], want[1]], rtol=1e-12, atol=1e-12)


def test_temperature_is_the_best_of_a_grid():
    rng = np.random.default_rng(4)
    s = rng.normal(size=(400, CLASSES)) * 3
    labels = np.array([rng.choice(CLASSES, p=linear.softmax(x / 2.5)) for x in s])

    def loss(t):
        return -sum(math.log(linear.softmax(x / t)[y]) for x, y in zip(s, labels)) / len(s)

    got = linear.temperature(s, labels)
    assert loss(got) <= min(loss(t) for t in np.geomspace(0.05, 20, 200)) + 1e-9
    assert 1.8 < got < 3.5
    assert linear.temperature(np.zeros((0, CLASSES)), np.zeros(0, int)) == 1.0


def test_logistic_fit_is_where_the_gradient_ends():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2))
    y = (rng.random(300) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + 0.5)))).astype(float)
    w = linear.logistic_fit(x, y)
    for k in range(3):
        g = 1e-2 * w[k]
        for row, label in zip(x, y):
            full = [*row, 1.0]
            g += full[k] * (1 / (1 + math.exp(-sum(a * b for a, b in zip(full, w)))) - label)
        assert abs(g) < 1e-6
