"""A small gated recurrent network with a class-factored softmax, in numpy: forward, truncated backpropagation, Adam.

There are fewer than 2 ** 16 symbols, numbered by class: symbols firsts[c] up to firsts[c + 1] are the members of class c. The probability of a symbol is
that of its class times, in classes of more than one, a softmax over the members. The network reads the symbol before.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

HIDDEN, EMBEDDING = 16, 12
#: Steps of a window of backpropagation; the state is carried from one to the next.
STEPS = 16
#: Lanes are texts side by side. A task takes as many as leave each LANE_TOKENS tokens at least.
MOST_LANES, LANE_TOKENS = 512, 4096
RATE, DECAY, SEED = 0.01, 0.999, 7
#: Texts that are scored side by side, and tokens of a window of them.
_BATCH, _SCORE_TOKENS = 1024, 8192

Params = dict[str, np.ndarray]


def initial(class_counts: np.ndarray, symbol_counts: np.ndarray, firsts: np.ndarray, seed: int = SEED) -> Params:
    """Weights that give each symbol its share of the counts, whatever the state; a class of -0.5 counts has none."""
    chance, f = np.random.default_rng(seed), np.float32
    size = len(symbol_counts)
    share = np.log(np.maximum(class_counts + 0.5, 1e-13))
    inner = np.log(symbol_counts + 0.5)
    return {
        "embedding": chance.normal(0, 0.3, (size, EMBEDDING)).astype(f), "w_in": chance.normal(0, 0.3, (EMBEDDING, 3 * HIDDEN)).astype(f),
        "b_in": np.concatenate([np.zeros(HIDDEN), np.full(HIDDEN, 1.0), np.zeros(HIDDEN)]).astype(f), "w_state": chance.normal(0, 0.2, (HIDDEN, 3 * HIDDEN)).astype(f),
        "w_class": np.zeros((HIDDEN, len(class_counts)), f), "b_class": (share - share.max()).astype(f), "w_out": np.zeros((size, HIDDEN), f), "b_out": (inner - inner.max()).astype(f),
    }


def flat(p: Params) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _parts(v: np.ndarray, like: Params) -> Params:
    """``v`` as views of the shapes of ``like``."""
    out, at = {}, 0
    for k in sorted(like):
        out[k] = v[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def unflat(v: np.ndarray, like: Params) -> Params:
    return {k: x.astype(np.float32) for k, x in _parts(v, like).items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _affine(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = x @ w
    out += b
    return out


def _sums(x: np.ndarray) -> np.ndarray:
    """Of each column."""
    return np.ones(len(x), x.dtype) @ x


def _exponentials(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(x) of each row, in place, and the rows' sums; rows are shifted to a largest value of 0 if any value is far off."""
    if np.abs(x.max()) > 30:
        x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    return x, x @ np.ones(x.shape[1], x.dtype)


@dataclass
class Network:
    p: Params
    firsts: np.ndarray  # the first symbol of each class, and the number of symbols
    classes: np.ndarray = field(init=False)  # the class of each symbol

    def __post_init__(self) -> None:
        self.classes = np.repeat(np.arange(len(self.firsts) - 1), np.diff(self.firsts))
        self.wide = np.flatnonzero(np.diff(self.firsts) > 1)

    def _states(self, before: np.ndarray, h: np.ndarray, keep: np.ndarray | None = None, trace: list | None = None) -> np.ndarray:
        """States after each step, (steps, HIDDEN, lanes), from the states ``h``, (lanes, HIDDEN); ``keep``, which goes with a ``trace``, is 0 where a text begins.

        Lanes come last, so that the parts of the gates are whole rows. ``trace`` gets the states before, the gates and
        candidates, and what the state gives to them.
        """
        p, H = self.p, HIDDEN
        steps, lanes = before.shape
        x = np.ascontiguousarray((p["embedding"] @ p["w_in"] + p["b_in"])[before].transpose(0, 2, 1))
        out, w, h = np.empty((steps, H, lanes), x.dtype), np.ascontiguousarray(p["w_state"].T), np.ascontiguousarray(h.T)
        if trace is not None:
            trace += [np.empty((steps, H, lanes), x.dtype), x, np.empty_like(x)]
        for t in range(steps):
            if trace is None:
                hp, a = h, w @ h
            else:
                hp = np.multiply(h, keep[t], out=trace[0][t])
                a = np.matmul(w, hp, out=trace[2][t])
            gates, n, h = x[t, : 2 * H], x[t, 2 * H :], out[t]
            gates += a[: 2 * H]
            _sigmoid(gates)
            n += np.multiply(gates[:H], a[2 * H :], out=h)
            np.tanh(n, out=n)
            np.subtract(hp, n, out=h)
            h *= gates[H:]
            h += n
        return out

    def _by_class(self, own: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
        """The places of symbols in classes of more than one member, by class; of each class its symbols and its share of the places."""
        order = np.argsort(own.astype(np.uint16), kind="stable")
        bounds = np.searchsorted(own[order], np.arange(len(self.firsts)))
        wide = [c for c in self.wide.tolist() if bounds[c] < bounds[c + 1]]
        order = np.concatenate([order[:0], *(order[bounds[c] : bounds[c + 1]] for c in wide)])
        at = np.cumsum([0, *(bounds[c + 1] - bounds[c] for c in wide)]).tolist()
        return order, [(int(self.firsts[c]), int(self.firsts[c + 1]), at[k], at[k + 1]) for k, c in enumerate(wide)]

    def log_probabilities(self, texts: list[np.ndarray], start: int) -> np.ndarray:
        """The natural logarithm of each text's probability; every text is read whole, from an empty state."""
        p, total = self.p, np.zeros(len(texts))
        order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
        for lo in range(0, len(order), _BATCH):
            own = order[lo : lo + _BATCH]
            lengths = np.array([len(texts[k]) for k in own])
            stream, firsts = np.concatenate([texts[k] for k in own]), np.cumsum(lengths) - lengths
            h, last = np.zeros((len(own), HIDDEN), np.float32), np.full(len(own), start, np.int64)
            t0 = 0
            while t0 < lengths[0]:
                n = int((lengths > t0).sum())
                steps = min(max(1, _SCORE_TOKENS // n), int(lengths[0]) - t0)
                at = t0 + np.arange(steps)[:, None]
                live = at < lengths[None, :n]
                target = np.where(live, stream[np.where(live, firsts[:n] + at, 0)], start)
                before = np.vstack([last[:n][None], target[:-1]])
                states = self._states(before, h[:n])
                h, last = states[-1].T, target[-1]
                flat_states, symbols = states.transpose(0, 2, 1)[live], target[live]
                own_class = self.classes[symbols]
                found = self._chosen(_affine(flat_states, p["w_class"], p["b_class"]), own_class)
                wide, parts = self._by_class(own_class)
                s, chosen, more = flat_states[wide], symbols[wide], np.empty(len(wide))
                for a, b, i, j in parts:
                    more[i:j] = self._chosen(_affine(s[i:j], p["w_out"][a:b].T, p["b_out"][a:b]), chosen[i:j] - a)
                found[wide] += more
                total[own[:n]] += np.bincount(np.nonzero(live)[1], weights=found, minlength=n)
                t0 += steps
        return total

    @staticmethod
    def _chosen(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log softmax of one column of each row."""
        e, sums = _exponentials(logits)
        return np.log(e[np.arange(len(at)), at].astype(np.float64) + 1e-300) - np.log(sums)

    def gradients(self, before: np.ndarray, target: np.ndarray, keep: np.ndarray, live: np.ndarray, h: np.ndarray) -> tuple[Params, np.ndarray, float]:
        """Gradients of the mean negative log-likelihood over a window, the state at its end, and the summed loss."""
        p, H = self.p, HIDDEN
        trace: list = []
        states = self._states(before, h, keep, trace)
        steps, lanes = before.shape
        s, symbols, weight = states.transpose(0, 2, 1).reshape(-1, H), target.ravel(), live.ravel().astype(states.dtype)
        weight *= 1 / max(1.0, float(weight.sum()))
        own = self.classes[symbols]
        q, chance = self._errors(_affine(s, p["w_class"], p["b_class"]), own, weight)
        g = {"w_class": s.T @ q, "b_class": _sums(q), "w_out": np.zeros_like(p["w_out"]), "b_out": np.zeros_like(p["b_out"])}
        ds = q @ p["w_class"].T
        order, parts = self._by_class(own)
        sr, chosen, wr, more, inner = s[order], symbols[order], weight[order], np.empty((len(order), H), s.dtype), np.empty(len(order), s.dtype)
        for a, b, i, j in parts:
            e, inner[i:j] = self._errors(_affine(sr[i:j], p["w_out"][a:b].T, p["b_out"][a:b]), chosen[i:j] - a, wr[i:j])
            g["w_out"][a:b], g["b_out"][a:b] = e.T @ sr[i:j], _sums(e)
            np.matmul(e, p["w_out"][a:b], out=more[i:j])
        ds[order] += more
        loss = -float((np.log(chance + 1e-30) * (weight > 0)).sum() + (np.log(inner + 1e-30) * (wr > 0)).sum())
        ds = np.ascontiguousarray(ds.reshape(steps, lanes, H).transpose(0, 2, 1))
        hp, x, a = trace
        r, z, n = x[:, :H], x[:, H : 2 * H], x[:, 2 * H :]
        # What the gradient of a state is multiplied by, for all steps at once.
        by_n = 1 - n * n
        by_n *= 1 - z
        by_r = a[:, 2 * H :] * r
        by_r *= 1 - r
        by_z = hp - n
        by_z *= z
        by_z *= 1 - z
        dx, da, after = np.empty_like(x), np.empty_like(x), np.zeros((H, lanes), s.dtype)
        for t in range(steps - 1, -1, -1):
            dh, d = ds[t], da[t]
            dh += after
            dn = np.multiply(dh, by_n[t], out=dx[t, 2 * H :])
            np.multiply(dn, by_r[t], out=d[:H])
            np.multiply(dh, by_z[t], out=d[H : 2 * H])
            np.multiply(dn, r[t], out=d[2 * H :])
            np.matmul(p["w_state"], d, out=after)
            dh *= z[t]
            after += dh
            after *= keep[t]
        dx[:, : 2 * H] = da[:, : 2 * H]
        g["w_state"] = np.matmul(hp, da.transpose(0, 2, 1)).sum(axis=0)
        dx = dx.transpose(0, 2, 1).reshape(-1, 3 * H)
        read = before.ravel()
        g["w_in"], g["b_in"] = p["embedding"][read].T @ dx, _sums(dx)
        de, order = dx @ p["w_in"].T, np.argsort(read.astype(np.uint16), kind="stable")
        firsts = np.flatnonzero(np.diff(read[order], prepend=-1))
        g["embedding"] = np.zeros_like(p["embedding"])
        g["embedding"][read[order][firsts]] = np.add.reduceat(de[order], firsts, axis=0)
        return g, states[-1].T, loss

    @staticmethod
    def _errors(logits: np.ndarray, at: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Softmax of each row less one in the column ``at``, by weight; and the softmax there."""
        e, sums = _exponentials(logits)
        rows = np.arange(len(at))
        chance = e[rows, at] / sums
        e *= (weight / sums)[:, None]
        e[rows, at] -= weight
        return e, chance

    def train(self, texts: list[np.ndarray], start: int, rate: float = RATE) -> tuple[int, float]:
        """One pass of truncated backpropagation over ``texts``; the tokens read and their summed loss.

        The texts stand end to end, cut into lanes of equal length; the state is carried from window to window in a lane and
        empty where a text begins.
        """
        stream = np.concatenate(texts).astype(np.int64) if texts else np.zeros(0, np.int64)
        n = len(stream)
        if not n:
            return 0, 0.0
        begins = np.zeros(n, bool)
        begins[np.cumsum([0, *(len(t) for t in texts[:-1])])] = True
        before = np.concatenate([[start], stream[:-1]])
        before[begins] = start
        lanes = int(min(MOST_LANES, max(1, n // LANE_TOKENS)))
        length = -(-n // lanes)
        pad = lanes * length - n
        shaped = [np.concatenate([x, np.full(pad, fill, x.dtype)]).reshape(lanes, length).T for x, fill in ((before, start), (stream, start), (~begins, True), (np.ones(n, bool), False))]
        h, loss = np.zeros((lanes, HIDDEN), np.float32), 0.0
        weights = flat(self.p)
        self.p = _parts(weights, self.p)
        first, second, own = np.zeros_like(weights), np.zeros_like(weights), np.empty_like(weights)
        updates = -(-length // STEPS)
        for u in range(updates):
            b, y, keep, live = (x[u * STEPS : (u + 1) * STEPS] for x in shaped)
            g, h, more = self.gradients(b, y, keep.astype(np.float32), live, h)
            loss += more
            v = flat(g)
            norm = float(np.sqrt(v @ v))
            v *= min(1.0, 1.0 / (norm + 1e-9))
            step = rate * (1 - 0.9 * u / updates) * np.sqrt(1 - DECAY ** (u + 1)) / (1 - 0.9 ** (u + 1))
            np.subtract(v, first, out=own)
            own *= 0.1
            first += own
            v *= v
            v -= second
            v *= 1 - DECAY
            second += v
            np.sqrt(second, out=v)
            v += 1e-8
            np.divide(first, v, out=v)
            v *= step
            weights -= v
        return n, loss
