"""A character-level bidirectional LSTM with a CRF over tags, in numpy.

Arrays are batch x time x ...; sequences of a batch have one length each, kept in a mask. Training is by
gradient of the CRF's log-likelihood, back through time, with Adam.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: ASCII 32..126 are symbols of their own; then other letters, other digits, white space, anything else, padding.
N_SYMBOLS = 95 + 5
_LETTER, _DIGIT, _SPACE, _OTHER, PAD = 95, 96, 97, 98, 99


def _symbol(c: str) -> int:
    if " " <= c <= "~":
        return ord(c) - 32
    return _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _SPACE if c.isspace() else _OTHER


class _Symbols(dict):
    def __missing__(self, c: str) -> int:
        return _symbol(c) if len(self) > 50_000 else self.setdefault(c, _symbol(c))


_SYMBOLS = _Symbols()


def symbols(text: str) -> np.ndarray:
    return np.fromiter(map(_SYMBOLS.__getitem__, text), np.int64, len(text))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


@dataclass
class Tagger:
    """Weights by name; ``tags`` include the outside tag 0. ``allowed[i, j]``: may tag j follow tag i?"""

    w: dict[str, np.ndarray]
    allowed: np.ndarray

    @classmethod
    def new(cls, allowed: np.ndarray, embed: int, hidden: int, seed: int) -> Tagger:
        rng, tags = np.random.default_rng(seed), len(allowed)
        w = {"emb": rng.normal(0, 0.3, (N_SYMBOLS, embed))}
        for d in ("f", "b"):
            w[d + "x"] = rng.normal(0, embed ** -0.5, (embed, 4 * hidden))
            w[d + "h"] = rng.normal(0, hidden ** -0.5, (hidden, 4 * hidden))
            bias = np.zeros(4 * hidden)
            bias[hidden:2 * hidden] = 1.0
            w[d + "0"] = bias
        w["out"] = rng.normal(0, (2 * hidden) ** -0.5, (2 * hidden, tags))
        w["out0"], w["trans"], w["start"] = np.zeros(tags), np.zeros((tags, tags)), np.zeros(tags)
        return cls({k: v.astype(np.float32) for k, v in w.items()}, allowed)

    # -- network -------------------------------------------------------------------------------------------------

    def _lstm(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        wh, hidden = self.w[d + "h"], self.w[d + "h"].shape[0]
        pre = x @ self.w[d + "x"] + self.w[d + "0"]
        n, steps = mask.shape
        h = c = np.zeros((n, hidden), np.float32)
        out, tape = np.zeros((n, steps, hidden), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = pre[:, t] + h @ wh
            g = _sigmoid(z[:, :3 * hidden])
            i, f, o = g[:, :hidden], g[:, hidden:2 * hidden], g[:, 2 * hidden:]
            u = np.tanh(z[:, 3 * hidden:])
            m = mask[:, t, None]
            before = (h, c)
            c = m * (f * c + i * u)
            s = np.tanh(c)
            h = m * o * s
            out[:, t] = h
            if keep:
                tape.append((t, before, i, f, o, u, c, s, m))
        return out, tape

    def _lstm_back(self, grad: np.ndarray, x: np.ndarray, tape: list, d: str, g: dict) -> np.ndarray:
        wx, wh = self.w[d + "x"], self.w[d + "h"]
        dx = np.zeros_like(x)
        dh = dc = 0.0
        for t, (h0, c0), i, f, o, u, c, s, m in reversed(tape):
            dh = (dh + grad[:, t]) * m
            dc = (dc + dh * o * (1 - s * s)) * m
            dz = np.concatenate([dc * u * i * (1 - i), dc * c0 * f * (1 - f), dh * s * o * (1 - o), dc * i * (1 - u * u)], 1)
            g[d + "x"] += x[:, t].T @ dz
            g[d + "h"] += h0.T @ dz
            g[d + "0"] += dz.sum(0)
            dx[:, t] = dz @ wx.T
            dh, dc = dz @ wh.T, dc * f
        return dx

    def _network(self, ids: np.ndarray, mask: np.ndarray, keep: bool = False):
        x = self.w["emb"][ids]
        hf, tf = self._lstm(x, mask, "f", keep)
        hb, tb = self._lstm(x, mask, "b", keep)
        both = np.concatenate([hf, hb], 2)
        return both @ self.w["out"] + self.w["out0"], (x, both, tf, tb)

    # -- CRF -----------------------------------------------------------------------------------------------------

    def _steps(self) -> tuple[np.ndarray, np.ndarray]:
        return np.where(self.allowed, self.w["trans"], -1e4), np.where(self.allowed[0], self.w["start"], -1e4)

    def _marginals(self, score: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward log sums, log normaliser, tag marginals."""
        trans, start = self._steps()
        n, steps, tags = score.shape
        a, b = np.zeros((n, steps, tags)), np.zeros((n, steps, tags))
        a[:, 0] = start + score[:, 0]
        for t in range(1, steps):
            new = _logsumexp(a[:, t - 1, :, None] + trans, 1) + score[:, t]
            a[:, t] = np.where(mask[:, t, None] > 0, new, a[:, t - 1])
        for t in range(steps - 2, -1, -1):
            new = _logsumexp(trans + (score[:, t + 1] + b[:, t + 1])[:, None, :], 2)
            b[:, t] = np.where(mask[:, t + 1, None] > 0, new, 0.0)
        norm = _logsumexp(a[:, -1], 1)
        return a, b, norm, np.exp(a + b - norm[:, None, None]) * mask[..., None]

    def loss(self, ids: np.ndarray, mask: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the gold tags, and its gradient."""
        score, (x, both, tf, tb) = self._network(ids, mask, True)
        a, b, norm, marginal = self._marginals(score, mask)
        trans, start = self._steps()
        n, steps, tags = score.shape
        rows = np.arange(n)
        one = np.eye(tags)[gold] * mask[..., None]
        path = start[gold[:, 0]] + (score * one).sum((1, 2))
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        for t in range(1, steps):
            m = mask[:, t]
            path = path + m * trans[gold[:, t - 1], gold[:, t]]
            pair = np.exp(a[:, t - 1, :, None] + trans + (score[:, t] + b[:, t])[:, None, :] - norm[:, None, None]) * m[:, None, None]
            g["trans"] += pair.sum(0).astype(np.float32)
            np.subtract.at(g["trans"], (gold[:, t - 1], gold[:, t]), m.astype(np.float32))
        g["start"] += marginal[:, 0].sum(0).astype(np.float32)
        np.subtract.at(g["start"], gold[:, 0], 1.0)
        dscore = (marginal - one).astype(np.float32)
        g["out"] += both.reshape(-1, both.shape[2]).T @ dscore.reshape(-1, tags)
        g["out0"] += dscore.sum((0, 1))
        dboth = dscore @ self.w["out"].T
        half = both.shape[2] // 2
        dx = self._lstm_back(dboth[..., :half], x, tf, "f", g) + self._lstm_back(dboth[..., half:], x, tb, "b", g)
        np.add.at(g["emb"], ids, dx)
        del rows
        return float((norm - path).mean()), {k: v / n for k, v in g.items()}

    def decode(self, ids: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Most likely tag sequences, and the marginal probability of each of their tags."""
        score, _ = self._network(ids, mask)
        marginal = self._marginals(score, mask)[3]
        trans, start = self._steps()
        n, steps, tags = score.shape
        best, back = start + score[:, 0], np.zeros((n, steps, tags), np.int64)
        for t in range(1, steps):
            all_ = best[:, :, None] + trans
            back[:, t] = np.where(mask[:, t, None] > 0, all_.argmax(1), np.arange(tags))
            best = np.where(mask[:, t, None] > 0, all_.max(1) + score[:, t], best)
        out = np.zeros((n, steps), np.int64)
        out[:, -1] = best.argmax(1)
        for t in range(steps - 1, 0, -1):
            out[:, t - 1] = back[np.arange(n), t, out[:, t]]
        return out, np.take_along_axis(marginal, out[..., None], 2)[..., 0]

    def train(self, ids: np.ndarray, mask: np.ndarray, gold: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.01,
              seed: int = 0) -> list[float]:
        """Adam over shuffled batches; returns the mean loss of each epoch."""
        rng = np.random.default_rng(seed)
        one = {k: np.zeros_like(v) for k, v in self.w.items()}
        two = {k: np.zeros_like(v) for k, v in self.w.items()}
        step, losses = 0, []
        for _ in range(epochs):
            order, total = rng.permutation(len(ids)), 0.0
            for i in range(0, len(order), batch):
                pick = order[i:i + batch]
                loss, g = self.loss(ids[pick], mask[pick], gold[pick])
                total += loss * len(pick)
                step += 1
                size = min(1.0, 5.0 / (1e-9 + np.sqrt(sum(float((v * v).sum()) for v in g.values()))))
                for k, v in g.items():
                    v = v * size
                    one[k] = 0.9 * one[k] + 0.1 * v
                    two[k] = 0.999 * two[k] + 0.001 * v * v
                    self.w[k] -= (rate * (one[k] / (1 - 0.9 ** step)) / (np.sqrt(two[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
            losses.append(total / max(1, len(ids)))
        return losses
