import numpy as np

from millrace.operators.transformer import Transformer


def test_gradients():
    rng = np.random.default_rng(0)
    net = Transformer(3, 8, 2, 3, 10, 0.0, 1)
    assert net.heads == 2
    x, y = rng.normal(size=(5, 3)), rng.normal(size=5)
    out, p, _ = net.forward(x)
    out.backward(2 * (out.value - y) / 5)
    for k, w in net.w.items():
        if p[k].grad is None:
            assert k in ("g10", "s10")  # the first block's attention has no norm
            continue
        at = tuple(n // 2 for n in w.shape)
        loss = []
        for e in (1e-5, -1e-5):
            w[at] += e
            loss.append(((net.forward(x)[0].value - y) ** 2).mean())
            w[at] -= e
        assert np.isclose((loss[0] - loss[1]) / 2e-5, p[k].grad[at], atol=1e-6), k


def test_learns_a_line():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = x[:, 0] - 0.5 * x[:, 2]
    net = Transformer(3, 16, 2, 4, 32, 0.0, 0)
    history = net.train(x[:300], y[:300], x[300:], y[300:], 3e-3, 1e-5, epochs=40)
    assert 1 - ((net.predict(x[300:]) - y[300:]) ** 2).mean() / y[300:].var() > 0.9 and len(history) <= 40
    assert net.attention(x).shape == (3, 3)
