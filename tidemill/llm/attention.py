"""A small causal self-attention model over token classes, in numpy.

A class is a frequent token id, the escape class or the end of a text; classes lie
in ``GROUPS`` groups of ``MEMBERS``, so a probability is that of the group times
that of the member.  Logits are the logarithms of a smoothed bigram table plus
what one attention layer with learned distance biases and a feed-forward layer
add.  The output weights start at zero, so an untrained model is the bigram model.
"""

from __future__ import annotations

import numpy as np

GROUPS, MEMBERS = 32, 32
CLASSES = GROUPS * MEMBERS
WIDTH, HEADS, HIDDEN, LENGTH, OVERLAP = 24, 2, 24, 32, 6
SHAPES = {
    "e": (CLASSES, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "o": (WIDTH, WIDTH), "r": (HEADS, LENGTH),
    "w1": (WIDTH, HIDDEN), "b1": (HIDDEN,), "w2": (HIDDEN, WIDTH), "g": (WIDTH, GROUPS), "m": (GROUPS, WIDTH, MEMBERS),
}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())
_CAUSAL = np.tril(np.ones((LENGTH, LENGTH), bool))
_DISTANCE = np.where(_CAUSAL, np.arange(LENGTH)[:, None] - np.arange(LENGTH), 0)
_BY_HEAD = np.repeat(np.eye(HEADS, dtype=np.float32), WIDTH // HEADS, 0)
_HALVES = np.repeat(np.eye(2, dtype=np.float32), [GROUPS, MEMBERS], 0)
#: Windows whose activations stay in a core's cache.
BLOCK = 32


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def initial(seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    flat = np.zeros(SIZE, np.float32)
    p = unpack(flat)
    p["e"][:] = rng.normal(0, 0.5, p["e"].shape)
    for name in ("q", "k"):
        p[name][:] = rng.normal(0, 0.1, p[name].shape)
    for name in ("v", "o", "w1", "w2"):
        p[name][:] = rng.normal(0, p[name].shape[0] ** -0.5, p[name].shape)
    p["r"][: HEADS - 1, 1] = 3.0  # heads but the last begin by looking at the token before
    p["r"][: HEADS - 1, 2] = 1.5
    return flat


def projected(p: dict) -> tuple[np.ndarray, np.ndarray]:
    """(per class: embedding, queries, keys, and of each head values and a one; the distance weights).

    Inputs are classes only, so projections are table rows: they are made once for a set of weights.
    """
    dh = WIDTH // HEADS
    table = np.ones((CLASSES, 3 * WIDTH + HEADS * (dh + 1)), np.float32)
    table[:, :WIDTH] = p["e"]
    np.matmul(p["e"], p["q"] * np.float32(dh**-0.5), out=table[:, WIDTH : 2 * WIDTH])
    np.matmul(p["e"], p["k"], out=table[:, 2 * WIDTH : 3 * WIDTH])
    table[:, 3 * WIDTH :].reshape(CLASSES, HEADS, dh + 1)[..., :dh] = (p["e"] @ p["v"]).reshape(CLASSES, HEADS, dh)
    return table, np.exp(p["r"])[:, None, _DISTANCE] * _CAUSAL


def _head(t: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries, keys and values (with the ones) of head ``j`` in gathered rows of the table."""
    dh = WIDTH // HEADS
    q, v = WIDTH + j * dh, 3 * WIDTH + j * (dh + 1)
    return t[..., q : q + dh], t[..., q + WIDTH : q + WIDTH + dh], t[..., v : v + dh + 1]


def _block(p: dict, tables: tuple[np.ndarray, np.ndarray], x: np.ndarray, begin: int, h: np.ndarray):
    """Activations of some windows; their hidden rows from place ``begin`` on go to ``h``."""
    n, length = x.shape
    dh, m = WIDTH // HEADS, length - begin
    t = tables[0].take(x, 0)
    a = np.empty((HEADS, n, m, length), np.float32)
    mixed, ones = np.empty((n, m, HEADS, dh), np.float32), np.ones(length, np.float32)
    for j in range(HEADS):
        q, k, v = _head(t, j)
        # small products are several times as fast with the right side as it lies
        np.matmul(q[:, begin:], np.ascontiguousarray(k.transpose(0, 2, 1)), out=a[j])
        np.exp(a[j], out=a[j])
        a[j] *= tables[1][j, :, begin:length, :length]
        np.matmul(a[j], v[..., :dh], out=mixed[:, :, j])
    inverse = 1 / (a.reshape(HEADS, n * m, length) @ ones)
    mixed = mixed.reshape(n * m, WIDTH)
    mixed *= inverse.T @ _BY_HEAD.T
    u = mixed @ p["o"]
    u.reshape(n, m, WIDTH)[:] += t[:, begin:, :WIDTH]
    z = u @ p["w1"]
    z += p["b1"]
    np.maximum(z, 0, out=z)
    np.matmul(z, p["w2"], out=h)
    h += u
    return t, a, inverse, mixed, u, z


def _hidden(p: dict, tables: tuple[np.ndarray, np.ndarray], x: np.ndarray, begin: int = 0):
    """(activations by block of windows, hidden rows of the places from ``begin`` on).

    Only keys and values of the places before ``begin`` are used, and blocks stay in a core's cache.
    """
    n, length = x.shape
    h = np.empty((n * (length - begin), WIDTH), np.float32)
    step = BLOCK * (length - begin)
    return [_block(p, tables, x[lo : lo + BLOCK], begin, h[k * step : (k + 1) * step]) for k, lo in enumerate(range(0, n, BLOCK))], h


def _exp_logits(p: dict, tables, h: np.ndarray, at: np.ndarray, prev: np.ndarray, target: np.ndarray):
    """The rows of ``h`` at ``at``, by group of their targets, and the exponentials of their logits.

    Returns (order, first row of each group, those rows, logit weights by group, exponentials of group and member logits, those
    of the targets, sums); the last three have the groups and the members beside each other.
    """
    order = np.argsort((target >> 5).astype(np.uint8), kind="stable")
    target, prev = target[order], prev[order]
    group = target >> 5
    edge = np.searchsorted(group, np.arange(GROUPS + 1))
    hs = h.take(at[order], 0)
    w = np.empty((GROUPS, WIDTH, GROUPS + MEMBERS), np.float32)
    w[..., :GROUPS] = p["g"]
    w[..., GROUPS:] = p["m"]
    e = np.empty((len(order), GROUPS + MEMBERS), np.float32)
    for c in range(GROUPS):
        s = slice(edge[c], edge[c + 1])
        np.matmul(hs[s], w[c], out=e[s])
    e[:, :GROUPS] += tables[0].take(prev, 0)
    e[:, GROUPS:] += tables[1].reshape(-1, MEMBERS).take(prev * GROUPS + group, 0)
    if e.size and e.max() > 60:  # logits are log probabilities plus small residuals, so none should be large
        np.minimum(e, np.float32(60), out=e)
    np.exp(e, out=e)
    place = np.arange(len(order)) * (GROUPS + MEMBERS)
    own = np.stack([place + group, place + GROUPS + (target & 31)], 1)
    return order, edge, hs, w, e, own, e @ _HALVES


def log_probs(p: dict, tables: tuple[np.ndarray, np.ndarray], x: np.ndarray, y: np.ndarray, mask: np.ndarray, ready: tuple | None = None) -> np.ndarray:
    """Natural log probability of the masked targets, in row order; ``ready`` is :func:`projected` of the weights."""
    begin = int(mask.any(0).argmax())
    at = np.flatnonzero(mask[:, begin:])
    h = _hidden(p, ready or projected(p), x, begin)[1]
    order, _, _, _, e, own, sums = _exp_logits(p, tables, h, at, x[:, begin:].ravel()[at], y[:, begin:].ravel()[at])
    got = e.ravel()[own]
    out = np.empty(len(at), np.float32)
    # a product of both could leave the range
    out[order] = np.log(got / sums).sum(1)
    return out


def gradient(flat: np.ndarray, tables, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Gradient of the mean negative log probability of the masked targets."""
    p, out = unpack(flat), np.empty(SIZE, np.float32)
    out.fill(0)
    d = unpack(out)
    blocks, h = _hidden(p, projected(p), x)
    n, length = x.shape
    dh, scale = WIDTH // HEADS, np.float32((WIDTH // HEADS) ** -0.5)
    at = np.flatnonzero(mask)
    x = x.ravel()
    order, edge, hs, w, e, own, sums = _exp_logits(p, tables, h, at, x[at], y.ravel()[at])
    count = np.float32(1 / max(1, len(at)))
    e.reshape(len(at), 2, -1)[:] *= (count / sums)[..., None]
    e.ravel()[own] -= count
    dw, dhs = np.empty_like(w), np.empty_like(hs)
    for c in range(GROUPS):
        s = slice(edge[c], edge[c + 1])
        np.matmul(hs[s].T, e[s], out=dw[c])
        np.matmul(e[s], w[c].T, out=dhs[s])
    d["g"][:] = dw[..., :GROUPS].sum(0)
    d["m"][:] = dw[..., GROUPS:]
    dhidden = h  # no longer needed
    if len(at) < len(h):
        dhidden[:] = 0
    dhidden[at[order]] = dhs
    qkv = np.concatenate([p["q"] * scale, p["k"], p["v"]], 1)
    d_qkv, demb = np.zeros_like(qkv), np.empty_like(h)
    by_distance = np.zeros((HEADS, length * length), np.float32)
    lo = 0
    for t, a, inverse, mixed, u, z in blocks:
        b, hi = len(t), lo + len(u)
        dy = dhidden[lo:hi]
        dz = dy @ p["w2"].T
        dz *= z > 0
        ones = np.ones(len(dz), np.float32)
        d["w2"] += z.T @ dy
        d["w1"] += u.T @ dz
        d["b1"] += ones @ dz
        du = dz @ p["w1"].T
        du += dy
        d["o"] += mixed.T @ du
        dmixed = du @ p["o"].T
        # the softmax's slope needs sum(da * a) by row, which is the output's product with its own gradient; it goes beside the ones of the values
        split = np.empty((b, length, HEADS, dh + 1), np.float32)
        dmixed *= inverse.T @ _BY_HEAD.T
        mixed *= dmixed
        split[..., :dh] = dmixed.reshape(b, length, HEADS, dh)
        np.negative((mixed @ _BY_HEAD).reshape(b, length, HEADS), out=split[..., dh])
        turned = np.empty((b, length, 3, HEADS, dh), np.float32)
        for j in range(HEADS):
            q, k, v = _head(t, j)
            da = np.matmul(split[:, :, j], np.ascontiguousarray(v.transpose(0, 2, 1)))
            da *= a[j]
            by_distance[j] += ones[:b] @ da.reshape(b, -1)
            np.matmul(da, k, out=turned[:, :, 0, j])
            np.matmul(da.transpose(0, 2, 1), q, out=turned[:, :, 1, j])
            np.matmul(a[j].transpose(0, 2, 1), split[:, :, j, :dh], out=turned[:, :, 2, j])
        turned = turned.reshape(hi - lo, 3 * WIDTH)
        d_qkv += t.reshape(hi - lo, -1)[:, :WIDTH].T @ turned
        np.matmul(turned, qkv.T, out=demb[lo:hi])
        demb[lo:hi] += du
        lo = hi
    for j in range(HEADS):
        d["r"][j] = np.bincount(_DISTANCE[:length, :length].ravel(), by_distance[j] * _CAUSAL[:length, :length].ravel(), LENGTH)
    d["q"][:], d["k"][:], d["v"][:] = d_qkv[:, :WIDTH] * scale, d_qkv[:, WIDTH : 2 * WIDTH], d_qkv[:, 2 * WIDTH :]
    order = np.argsort(x.astype(np.uint16), kind="stable")
    sx = x[order]
    first = np.flatnonzero(np.concatenate([[True], sx[1:] != sx[:-1]]))
    d["e"][sx[first]] = np.add.reduceat(demb.take(order, 0), first)
    return out


class Adam:
    def __init__(self, flat: np.ndarray, rate: float = 3e-3):
        self.flat, self.rate, self.t = flat.copy(), rate, 0
        self.m, self.v = np.zeros_like(flat), np.zeros_like(flat)

    def step(self, g: np.ndarray) -> None:
        self.t += 1
        self.m += np.float32(0.1) * (g - self.m)
        self.v += np.float32(0.01) * (g * g - self.v)
        warm = min(1.0, self.t / 20)
        rate = np.float32(self.rate * warm * (1 - 0.99**self.t) ** 0.5 / (1 - 0.9**self.t))
        self.flat -= rate * self.m / (np.sqrt(self.v) + np.float32(1e-8))


def windows(classes: np.ndarray, off: np.ndarray, end: int, length: int = LENGTH, overlap: int = OVERLAP):
    """(inputs, targets, mask, text of each window): every target of every text is masked in once.

    ``classes``: the texts' classes, each text followed by ``end``; ``off``: n + 1 offsets.
    """
    size = np.diff(off)
    stride = length - overlap
    n_win = np.where(size > 0, 1 + np.maximum(0, -(-(size - length) // stride)), 0)
    text = np.repeat(np.arange(len(size)), n_win)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n_win) - n_win, n_win)
    begin = off[:-1][text] + k * stride
    at = begin[:, None] + np.arange(length)
    stop = off[1:][text][:, None]
    mask = (at < stop) & ((k == 0)[:, None] | (np.arange(length) >= overlap))
    at = np.minimum(at, stop - 1)
    y = classes[at]
    x = classes[np.maximum(at - 1, 0)]
    x[at == off[:-1][text][:, None]] = end
    return x, y, mask, text


def tables_of(bigrams: np.ndarray, strength: float = 20.0) -> tuple[np.ndarray, np.ndarray]:
    """(log group, log member) tables by previous class of smoothed bigram counts."""
    b = bigrams.astype(np.float64)
    uni = (b.sum(0) + 1) / (b.sum() + CLASSES)
    joint = (b + strength * uni) / (b.sum(1, keepdims=True) + strength)
    cube = joint.reshape(CLASSES, GROUPS, MEMBERS)
    return np.log(cube.sum(2)).astype(np.float32), np.log(cube).astype(np.float32)
