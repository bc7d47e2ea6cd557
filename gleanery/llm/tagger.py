"""A character-level bidirectional LSTM with CRF transitions, in numpy: training by backpropagation, decoding by Viterbi."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: 0 is outside; 2k + 1 begins a span of kind k, 2k + 2 continues it.
TAGS = 1 + 2 * len(KINDS)
WIDTH = 64
HIDDEN = 24
FAR = -1e4
#: A tag's emission counts as no further than this below the best one.
LEAST = -60.0

_PUNCT = " \n@.-+()_:/#%&=\"',;|!?[]{}<>*$~"
_CODE = np.full(128, 3, np.int64)  # 0 padding, 1 digit, 2 upper case, 3 other ASCII, 4 beyond ASCII
_CODE[48:58] = 1
_CODE[65:91] = 2
_CODE[97:123] = np.arange(5, 31)
for _i, _c in enumerate(_PUNCT):
    _CODE[ord(_c)] = 31 + _i
ALPHABET = 31 + len(_PUNCT)


def codes(points: np.ndarray) -> np.ndarray:
    return np.where(points < 128, _CODE[np.minimum(points, 127)], 4)


def allowed() -> np.ndarray:
    """Transition mask: a span continues only one of its own kind."""
    ok = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        ok[:, 2 * k + 2] = False
        ok[[2 * k + 1, 2 * k + 2], 2 * k + 2] = True
    return ok


ALLOWED = allowed()
STARTS = np.array([0.0] + [0.0, FAR] * len(KINDS), np.float32)


@dataclass
class Model:
    table: np.ndarray  # (2, ALPHABET, 4H): input weights of both directions, one row a character
    inner: np.ndarray  # (2, H, 4H)
    bias: np.ndarray  # (2, 4H)
    out: np.ndarray  # (2H, TAGS)
    out_bias: np.ndarray  # (TAGS,)
    trans: np.ndarray  # (TAGS, TAGS)

    @classmethod
    def fresh(cls, seed: int) -> Model:
        r, h = np.random.default_rng(seed), HIDDEN
        n = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        bias = np.zeros((2, 4 * h), np.float32)
        bias[:, h : 2 * h] = 1.0
        return cls(n(2, ALPHABET, 4 * h, scale=0.3), n(2, h, 4 * h, scale=1 / np.sqrt(h)), bias, n(2 * h, TAGS, scale=0.2), np.zeros(TAGS, np.float32), np.zeros((TAGS, TAGS), np.float32))

    def params(self) -> list[np.ndarray]:
        return [self.table, self.inner, self.bias, self.out, self.out_bias, self.trans]

    def transitions(self) -> np.ndarray:
        return np.where(ALLOWED, self.trans, np.float32(FAR))


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _lstm(model: Model, x: np.ndarray, keep: bool = False):
    """Hidden states (T, B, 2H) for codes (T, B), the forward direction's first.  Both directions run side by side; what is
    kept for the gradients stands in the order in which each reads."""
    h, (steps, b) = HIDDEN, x.shape
    put, turned = model.table + model.bias[:, None], x[::-1]
    cell = state = np.zeros((2, b, h), model.inner.dtype)
    out, held = np.empty((steps, b, 2 * h), model.inner.dtype), []
    for t in range(steps):
        g = state @ model.inner
        g[0] += put[0][x[t]]
        g[1] += put[1][turned[t]]
        s = _sigmoid(g[..., : 3 * h])
        i, f, o, c = s[..., :h], s[..., h : 2 * h], s[..., 2 * h :], np.tanh(g[..., 3 * h :])
        before, was = cell, state
        cell = f * cell + i * c
        th = np.tanh(cell)
        state = o * th
        out[t, :, :h], out[steps - 1 - t, :, h:] = state[0], state[1]
        if keep:
            held.append((i, f, o, c, before, th, was))
    return out, held


def emissions(model: Model, x: np.ndarray) -> np.ndarray:
    """(T, B, TAGS) for codes (T, B)."""
    return _lstm(model, x)[0] @ model.out + model.out_bias


def forward_backward(e: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward and backward probabilities, whose product is each tag's marginal, the weight with which a step enters
    a pair of tags, and the logarithm of the sum over all paths."""
    top, step = e.max(axis=2, keepdims=True), np.exp(trans.astype(np.float64))
    put = np.exp(np.maximum((e - top).astype(np.float64), LEAST))
    alpha, beta, scale = np.empty_like(put), np.ones_like(put), np.empty((*e.shape[:2], 1))
    for t in range(len(e)):
        now = put[t] * (alpha[t - 1] @ step if t else np.exp(STARTS))
        scale[t] = now.sum(axis=1, keepdims=True)
        alpha[t] = now / scale[t]
    enter = put / scale
    for t in range(len(e) - 2, -1, -1):
        enter[t + 1] *= beta[t + 1]
        beta[t] = enter[t + 1] @ step.T
    return alpha, beta, enter, (np.log(scale) + top).sum(axis=(0, 2))


def marginals(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    alpha, beta, _, _ = forward_backward(e, trans)
    return alpha * beta


def viterbi(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best tags (T, B), the first of equal ones."""
    best = np.empty_like(e)
    best[0] = e[0] + STARTS
    for t in range(1, len(e)):
        best[t] = e[t] + (best[t - 1].T[:, :, None] + trans[:, None, :]).max(axis=0)
    tags = np.empty(e.shape[:2], np.int64)
    tags[-1] = best[-1].argmax(1)
    for t in range(len(e) - 1, 0, -1):
        tags[t - 1] = (best[t - 1] + trans.T[tags[t]]).argmax(1)
    return tags


def gradients(model: Model, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean negative log-likelihood of tags (T, B) and its gradients."""
    steps, b = x.shape
    h = HIDDEN
    both, held = _lstm(model, x, True)
    e = both @ model.out + model.out_bias
    trans = model.transitions()
    alpha, beta, enter, z = forward_backward(e, trans)
    at = (np.arange(steps)[:, None], np.arange(b), y)
    gold = e[at].sum() + trans[y[:-1], y[1:]].sum()
    g_e = alpha * beta
    g_e[at] -= 1
    g_e = (g_e / b).astype(e.dtype)
    g_trans = np.exp(trans.astype(np.float64)) * (alpha[:-1].reshape(-1, TAGS).T @ enter[1:].reshape(-1, TAGS))
    np.add.at(g_trans, (y[:-1].ravel(), y[1:].ravel()), -1)
    g_trans = (g_trans / b * ALLOWED).astype(e.dtype)
    g_out, g_out_bias = both.reshape(-1, 2 * h).T @ g_e.reshape(-1, TAGS), g_e.sum((0, 1))
    g_both = g_e @ model.out.T
    g_put = np.empty((2, steps, b, 4 * h), e.dtype)
    g_state, g_cell, back = np.zeros((2, b, h), e.dtype), np.zeros((2, b, h), e.dtype), model.inner.transpose(0, 2, 1)
    for t in range(steps - 1, -1, -1):
        i, f, o, c, before, th, _ = held[t]
        g_state[0] += g_both[t, :, :h]
        g_state[1] += g_both[steps - 1 - t, :, h:]
        g_cell = g_cell + g_state * o * (1 - th * th)
        g = g_put[:, t]
        g[..., :h] = g_cell * c * i * (1 - i)
        g[..., h : 2 * h] = g_cell * before * f * (1 - f)
        g[..., 2 * h : 3 * h] = g_state * th * o * (1 - o)
        g[..., 3 * h :] = g_cell * i * (1 - c * c)
        g_state = g @ back
        g_cell = g_cell * f
    g_put = g_put.reshape(2, -1, 4 * h)
    was = np.stack([row[-1] for row in held], axis=1).reshape(2, -1, h)
    one = [(codes.reshape(-1, 1) == np.arange(ALPHABET)).astype(e.dtype) for codes in (x, x[::-1])]
    g_table = np.stack([one[d].T @ g_put[d] for d in (0, 1)])
    return float((z.sum() - gold) / b), [g_table, was.transpose(0, 2, 1) @ g_put, g_put.sum(axis=1), g_out, g_out_bias, g_trans]


def train(windows: np.ndarray, tags: np.ndarray, *, steps: int, batch: int = 64, rate: float = 0.02, seed: int = 7) -> Model:
    """Adam over random batches of (N, WIDTH) codes and tags."""
    model, r = Model.fresh(seed), np.random.default_rng(seed)
    m1, m2 = [np.zeros_like(p) for p in model.params()], [np.zeros_like(p) for p in model.params()]
    for n in range(1, steps + 1):
        pick = r.integers(0, len(windows), batch)
        _, grads = gradients(model, windows[pick].T, tags[pick].T)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        lr = rate * (1 - 0.9 * n / steps)
        for p, g, a, v in zip(model.params(), grads, m1, m2, strict=True):
            g = g * min(1.0, 5.0 / (norm + 1e-9))
            a += 0.1 * (g - a)
            v += 0.01 * (g * g - v)
            p -= (lr * (a / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.99**n)) + 1e-8)).astype(np.float32)
    return model
