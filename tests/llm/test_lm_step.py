"""A training step moves the weights by the gradients of the plain formulas."""

import numpy as np
import pytest

from docketlake.llm.lm_scoring import KEY, WINDOW, AttentionModel, _exp

V = 40


def loss(p, classes, tokens, lens):
    total = 0.0
    for row, n in zip(tokens, lens):
        x = p["x"][row[: n - 1]]
        q, k, v = x @ p["q"], x @ p["k"], x @ p["val"]
        for i in range(n - 1):
            s = q[i] @ k[: i + 1].T * KEY**-0.5 + p["rel"][i::-1]
            w = np.exp(s - s.max())
            z = (w / w.sum()) @ v[: i + 1] @ p["out"] + x[i] @ p["direct"] + p["bias"]
            total += z.max() + np.log(np.exp(z - z.max()).sum()) - z[classes[row[i + 1]]]
    return total / len(tokens)


@pytest.mark.parametrize("scale", [1.0, 30.0])
def test_step_follows_the_gradients(scale):
    r = np.random.default_rng(3)
    m = AttentionModel(V, V - 2, V - 1)
    m.p["x"][:] = r.normal(0, 0.5, m.p["x"].shape)
    m.p["rel"][:] = r.normal(0, 0.3, WINDOW)
    m.p["direct"] *= scale
    m.p["q"] *= scale
    tokens, lens = r.integers(0, V, (3, WINDOW + 1)), np.array([WINDOW + 1, 9, 2])
    before = {k: w.astype(np.float64) for k, w in m.p.items()}
    m._step(tokens, lens, 0.1)
    for name, w in before.items():
        for at in r.choice(w.size, 8, replace=False):
            at, sides = np.unravel_index(at, w.shape), []
            for e in (1e-5, -1e-5):
                w[at] += e
                sides.append(loss(before, m.classes, tokens, lens))
                w[at] -= e
            g = (sides[0] - sides[1]) / 2e-5
            moved = w[at] - m.p[name][at]
            assert moved == pytest.approx(0.1 * g / np.sqrt(1e-4 + g * g), abs=3e-4), (name, at)


def test_exp_stays_in_range():
    x = np.float32([[90, 1000, 0], [-200, -201, 5], [1, 2, 3]])
    there = np.array([[True, True, False], [True, True, False], [True, True, True]])
    _exp(x, there)
    x /= x.sum(1, keepdims=True)
    assert np.isfinite(x).all() and not x[~there].any()
    assert x[1] == pytest.approx([1 / (1 + np.exp(-1)), np.exp(-1) / (1 + np.exp(-1)), 0], rel=1e-5)
