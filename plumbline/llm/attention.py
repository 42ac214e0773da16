"""A small causal self-attention model in numpy: one head, one hidden layer, classes of ids as output.

Ids are read through an embedding of input symbols and predicted in two steps: the model gives the class, and counts
give the id in its class. The class's logits start from fixed offsets, the log shares of classes after the symbol
before (``offsets``, symbols by classes), so that what is learnt here is what the wider context adds to the pair.
Sequences are cut into windows that overlap; each position is scored once, in the first window that holds it with at
least ``OVERLAP`` positions before it (or all there are).
"""

from __future__ import annotations

import numpy as np

WIDTH = 16
HIDDEN = 32
WINDOW = 32
OVERLAP = 8
SHAPES = {"wq": (WIDTH, WIDTH), "wk": (WIDTH, WIDTH), "wv": (WIDTH, WIDTH), "wo": (WIDTH, WIDTH), "w1": (WIDTH, HIDDEN), "b1": (HIDDEN,), "w2": (HIDDEN, WIDTH), "b2": (WIDTH,)}


def start(symbols: int, classes: int, seed: int = 7) -> dict[str, np.ndarray]:
    """Fresh weights."""
    rng = np.random.default_rng(seed)
    p = {k: (rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 else np.zeros(s)) for k, s in SHAPES.items()}
    p |= {"e": rng.normal(0, 0.5, (symbols, WIDTH)), "p": rng.normal(0, 0.1, (WINDOW, WIDTH)), "wc": rng.normal(0, 0.01, (WIDTH, classes)), "bc": np.zeros(classes)}
    return {k: v.astype(np.float32) for k, v in sorted(p.items())}


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def unflat(x: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = x[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def windows(lengths: np.ndarray, overlap: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sequences laid end to end: positions (n, WINDOW), which of them are scored, and each window's sequence."""
    overlap = OVERLAP if overlap is None else overlap
    step = WINDOW - overlap
    n = np.where(lengths > 0, 1 + np.maximum(0, -(-(lengths - WINDOW) // step)), 0)
    of = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    at = (k * step)[:, None] + np.arange(WINDOW)[None, :]
    scored = (at < lengths[of][:, None]) & ((k == 0)[:, None] | (np.arange(WINDOW) >= overlap)[None, :])
    begin = (np.cumsum(lengths) - lengths)[of][:, None]
    return np.minimum(begin + at, (begin + lengths[of][:, None]) - 1), scored, of


_SEEN = np.tril(np.ones((WINDOW, WINDOW), np.float32))


def _times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w as one product over all but the last axis, which is faster than one for each window."""
    return (x.reshape(-1, x.shape[-1]) @ w).reshape(*x.shape[:-1], w.shape[1])


def _added(x: np.ndarray) -> np.ndarray:
    """Sum over all but the last axis, as a product, which is faster."""
    x = x.reshape(-1, x.shape[-1])
    return np.ones(len(x), x.dtype) @ x


def _inputs_weights(p: dict[str, np.ndarray]) -> np.ndarray:
    """wq, wk and wv side by side; wq has the scale of the products in it."""
    return np.concatenate([p["wq"] * p["wq"].dtype.type(WIDTH**-0.5), p["wk"], p["wv"]], axis=1)


def forward(p: dict[str, np.ndarray], w: np.ndarray, sym: np.ndarray) -> dict[str, np.ndarray]:
    """What the model makes of symbols (n, WINDOW); w: ``_inputs_weights``. ``a`` isn't divided by its rows' sums; ``r``
    is one over them."""
    x = p["e"].take(sym, axis=0)
    x += p["p"]
    wide = _times(x, w)
    q, k, v = wide[..., :WIDTH], wide[..., WIDTH : 2 * WIDTH], wide[..., 2 * WIDTH :]
    # Clipping instead of subtracting a maximum keeps the exponentials finite.
    a = q @ np.ascontiguousarray(k.transpose(0, 2, 1))
    np.clip(a, -40, 40, out=a)
    np.exp(a, out=a)
    a *= _SEEN
    r = 1 / _times(a, np.ones((WINDOW, 1), a.dtype))
    c = a @ v
    c *= r
    h = _times(c, p["wo"])
    h += x
    u = _times(h, p["w1"])
    u += p["b1"]
    np.maximum(u, 0, out=u)
    # A last column of ones, so that products with ``g`` have the bias in them.
    g = np.empty((sym.size, WIDTH + 1), x.dtype)
    g[:, WIDTH] = 1
    own = _times(u, p["w2"])
    own += h
    own += p["b2"]
    g[:, :WIDTH] = own.reshape(-1, WIDTH)
    return {"x": x, "q": q, "k": k, "v": v, "a": a, "r": r, "c": c, "h": h, "u": u, "g": g}


#: Windows that are worked on at a time, and rows whose class logits are: those stay in a core's cache.
TOGETHER, ROWS = 64, 512


class Logits:
    """Class logits of some rows at a time, in memory that is used again."""

    def __init__(self, offsets: np.ndarray):
        self.offsets, self.range = offsets, (offsets.min(initial=0), offsets.max(initial=0))
        self.out, self.picked = np.empty((2, ROWS, offsets.shape[1]), offsets.dtype)
        self.ones = np.ones(offsets.shape[1], offsets.dtype)

    def weigh(self, p: dict[str, np.ndarray]) -> None:
        self.w = np.concatenate([p["wc"], p["bc"][None]])
        self.norm = np.sqrt((self.w * self.w).sum(0).max())

    def of(self, g: np.ndarray, sym: np.ndarray) -> np.ndarray:
        """g: rows of ``forward``, sym: the symbols before. Clipped where the vectors' lengths don't rule out that a
        logit is below -80 or above 60."""
        z = np.matmul(g, self.w, out=self.out[: len(g)])
        z += self.offsets.take(sym, axis=0, out=self.picked[: len(g)], mode="clip")
        bound = self.norm * np.sqrt(_times(g * g, np.ones((g.shape[1], 1), g.dtype)).max(initial=0))
        if not (bound - self.range[0] < 80 and bound + self.range[1] < 60):
            np.clip(z, -80, 60, out=z)
        return z


def score(p: dict[str, np.ndarray], offsets: np.ndarray, sym: np.ndarray, cls: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural log probability of the class at each position of sequences laid end to end."""
    at, scored, _ = windows(lengths)
    out, logits, w = np.zeros(int(lengths.sum()), np.float32), Logits(offsets), _inputs_weights(p)
    logits.weigh(p)
    for i in range(0, len(at), TOGETHER):
        rows, take = at[i : i + TOGETHER], np.flatnonzero(scored[i : i + TOGETHER])
        spots, g = rows.ravel().take(take), forward(p, w, sym.take(rows))["g"].take(take, axis=0)
        for j in range(0, len(spots), ROWS):
            part = spots[j : j + ROWS]
            z = logits.of(g[j : j + ROWS], sym.take(part))
            own = z[np.arange(len(z)), cls.take(part)]
            np.exp(z, out=z)
            out[part] = own - np.log(z @ logits.ones)
    return out


def _backward(p: dict[str, np.ndarray], w: np.ndarray, logits: Logits, sym: np.ndarray, cls: np.ndarray, scored: np.ndarray, n: float) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
    """Of up to TOGETHER windows: the sum of losses, gradients of their share of a mean over ``n``, those by the inputs."""
    f, d, y, weight = forward(p, w, sym), {}, cls.ravel(), scored.ravel().astype(w.dtype)
    before, dg, wide, back, loss = sym.ravel(), np.empty((sym.size, WIDTH), w.dtype), 0, p["wc"].T, 0.0
    for i in range(0, sym.size, ROWS):
        rows = slice(i, i + ROWS)
        z = logits.of(f["g"][rows], before[rows])
        spot = np.arange(len(z)), y[rows]
        own = z[spot]
        np.exp(z, out=z)
        s = z @ logits.ones
        loss += float(weight[rows] @ (np.log(s) - own))
        # A row's gradient by its logits is z less s at its own class, times weight / (s n); that goes to the narrow side.
        z[spot] -= s
        part = (weight[rows] / (s * n))[:, None]
        wide += (f["g"][rows] * part).T @ z
        np.multiply(z @ back, part, out=dg[rows])
    d["wc"], d["bc"] = wide[:-1], wide[-1]
    u, h, c = f["u"].reshape(-1, HIDDEN), f["h"].reshape(-1, WIDTH), f["c"]
    d["w2"], d["b2"] = u.T @ dg, _added(dg)
    du = dg @ p["w2"].T
    du *= u > 0
    d["w1"], d["b1"] = (du.T @ h).T, _added(du)
    dh = du @ p["w1"].T
    dh += dg
    d["wo"] = c.reshape(-1, WIDTH).T @ dh
    dc = (dh @ p["wo"].T).reshape(c.shape)
    dc *= f["r"]
    # A row's sum of da * a is dc times c, since c is a times v.
    da = dc @ np.ascontiguousarray(f["v"].transpose(0, 2, 1))
    da -= _times(dc * c, np.ones((WIDTH, 1), c.dtype))
    da *= f["a"]
    both = np.empty((*sym.shape, 3 * WIDTH), c.dtype)
    np.matmul(da, f["k"], out=both[..., :WIDTH])
    np.matmul(da.transpose(0, 2, 1), f["q"], out=both[..., WIDTH : 2 * WIDTH])
    np.matmul(f["a"].transpose(0, 2, 1), dc, out=both[..., 2 * WIDTH :])
    both = both.reshape(-1, 3 * WIDTH)
    wide = (both.T @ f["x"].reshape(-1, WIDTH)).reshape(3, WIDTH, WIDTH)
    d["wq"], d["wk"], d["wv"] = (wide[0] * w.dtype.type(WIDTH**-0.5)).T, wide[1].T, wide[2].T
    dx = both @ w.T
    dx += dh
    d["p"] = np.ones(len(sym), w.dtype) @ dx.reshape(len(sym), -1)
    return loss, d, dx


def gradients(p: dict[str, np.ndarray], offsets: np.ndarray, sym: np.ndarray, cls: np.ndarray, scored: np.ndarray, logits: Logits | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over the scored positions and its gradients; sym, cls, scored: (n, WINDOW)."""
    w, logits, n = _inputs_weights(p), logits or Logits(offsets), float(np.count_nonzero(scored))
    logits.weigh(p)
    found = [_backward(p, w, logits, *(x[i : i + TOGETHER] for x in (sym, cls, scored)), n) for i in range(0, len(sym), TOGETHER)]
    names = sorted(found[0][1])
    total = sum(np.concatenate([d[k].ravel() for k in names]) for _, d, _ in found)
    at = np.cumsum([0, *(p[k].size for k in names)])
    d = {k: total[i:j].reshape(p[k].shape) for k, i, j in zip(names, at[:-1], at[1:], strict=True)}
    # Rows of one symbol are added up as runs of the sorted symbols; "e" is sparse: symbols and their rows.
    flat, dx = sym.ravel(), np.concatenate([x for *_, x in found])
    order = np.argsort(flat.astype(np.uint16) if len(offsets) <= 2**16 else flat, kind="stable")  # short keys: radix sort
    held = flat[order]
    first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
    d["e"] = (held[first], np.add.reduceat(dx.take(order, axis=0), first, axis=0))
    return sum(x for x, *_ in found) / n, d


class Trainer:
    """Adam over shuffled windows; the state stays from one group of sequences to the next. Moments of a symbol's
    embedding move only where the symbol occurs."""

    def __init__(self, p: dict[str, np.ndarray], offsets: np.ndarray, *, rate: float, batch: int = 64, seed: int = 7):
        self.p, self.offsets, self.rate, self.batch = {k: v.copy() for k, v in p.items()}, offsets, rate, batch
        # All weights but the symbols' lie in one array, of which ``p`` has views, so that a step is a few operations.
        self.dense = [k for k in sorted(p) if k != "e"]
        self.w = np.concatenate([p[k].ravel() for k in self.dense])
        at = np.cumsum([0, *(p[k].size for k in self.dense)])
        self.p |= {k: self.w[i:j].reshape(p[k].shape) for k, i, j in zip(self.dense, at[:-1], at[1:], strict=True)}
        self.m, self.v = np.zeros_like(self.w), np.zeros_like(self.w)
        self.me, self.ve = np.zeros_like(p["e"]), np.zeros_like(p["e"])
        self.rng, self.t, self.seen, self.logits = np.random.default_rng(seed), 0, 0, Logits(offsets)

    def step(self, m: np.ndarray, v: np.ndarray, p: np.ndarray, g: np.ndarray) -> None:
        """Moves ``p``, and its moments, in place."""
        now = np.float32(self.rate * min(1.0, self.t / 50) / np.sqrt(1 + self.t / 400))
        one, two = np.float32(1 - 0.9**self.t), np.float32(1 - 0.99**self.t)
        m += np.float32(0.1) * (g - m)
        v += np.float32(0.01) * (g * g - v)
        p -= now * (m / one) / (np.sqrt(v / two) + np.float32(1e-8))

    def fit(self, sym: np.ndarray, cls: np.ndarray, lengths: np.ndarray) -> float:
        """One pass over sequences laid end to end, in windows side by side; the mean loss."""
        at, scored, _ = windows(lengths, 0)
        order, losses = self.rng.permutation(len(at)), []
        for i in range(0, len(at), self.batch):
            own = order[i : i + self.batch]
            rows = at.take(own, axis=0)
            loss, d = gradients(self.p, self.offsets, sym.take(rows), cls.take(rows), scored.take(own, axis=0), self.logits)
            losses.append(loss)
            self.t += 1
            self.step(self.m, self.v, self.w, np.concatenate([d[k].ravel() for k in self.dense]))
            spot, g = d["e"]
            m, v, e = (x.take(spot, axis=0) for x in (self.me, self.ve, self.p["e"]))
            self.step(m, v, e, g)
            self.me[spot], self.ve[spot], self.p["e"][spot] = m, v, e  # these were copies
        self.seen += int(lengths.sum())
        return float(np.mean(losses)) if losses else 0.0
