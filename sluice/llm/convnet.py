"""A small byte convolutional network in numpy.

Bytes are embedded, convolved with filters of several widths, max-pooled over
the window and classified by softmax. Training is mini-batch Adam with the
gradient of the pooled maxima only. For prediction the embedding and each pair
of filter taps are multiplied out into tables over two bytes, so a filter of
width four costs two table rows for each position.
"""

from __future__ import annotations

import numpy as np

WIDTHS = (2, 3, 4)


def windows_of(data: bytes, length: int) -> np.ndarray:
    """All of ``data`` as rows of ``length`` bytes; the last row ends with the data, a short text is padded with blanks."""
    x = np.frombuffer(data, np.uint8)
    if len(x) <= length:
        return np.pad(x, (0, length - len(x)), constant_values=32)[None]
    whole = x[: len(x) // length * length].reshape(-1, length)
    return whole if len(x) % length == 0 else np.vstack([whole, x[-length:]])


class ByteConvNet:
    def __init__(self, classes: int, dim: int = 8, filters: int = 16, widths: tuple[int, ...] = WIDTHS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.widths, self.filters, self.rng = widths, filters, rng
        self.p = {"emb": rng.normal(0, 0.5, (256, dim)).astype(np.float32)}
        for w in widths:
            self.p[f"k{w}"] = (rng.normal(0, 1, (w * dim, filters)) / np.sqrt(w * dim)).astype(np.float32)
            self.p[f"c{w}"] = np.zeros(filters, np.float32)
        n = filters * len(widths)
        self.p["out"] = (rng.normal(0, 1, (n, classes)) / np.sqrt(n)).astype(np.float32)
        self.p["bias"] = np.zeros(classes, np.float32)

    def _step(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, dim, rows = self.p, self.p["emb"].shape[1], np.arange(len(x))[:, None]
        e, pooled, where = p["emb"][x], [], []
        for w in self.widths:
            cols = np.concatenate([e[:, j : x.shape[1] - w + 1 + j] for j in range(w)], axis=2)
            z = cols @ p[f"k{w}"] + p[f"c{w}"]
            at = z.argmax(axis=1)
            where.append((at, cols[rows, at]))
            pooled.append(np.take_along_axis(z, at[:, None], axis=1)[:, 0])
        raw = np.concatenate(pooled, axis=1)
        h = np.maximum(raw, 0)
        prob = softmax(h @ p["out"] + p["bias"])
        prob[np.arange(len(y)), y] -= 1
        g = prob / len(y)
        grads = {"out": h.T @ g, "bias": g.sum(axis=0), "emb": np.zeros_like(p["emb"])}
        gh = (g @ p["out"].T) * (raw > 0)
        for k, w in enumerate(self.widths):
            at, patch = where[k]
            gz = gh[:, k * self.filters : (k + 1) * self.filters]
            grads[f"k{w}"] = np.einsum("bf,bfk->kf", gz, patch)
            grads[f"c{w}"] = gz.sum(axis=0)
            back = gz[:, :, None] * p[f"k{w}"].T[None]
            for j in range(w):
                np.add.at(grads["emb"], x[rows, at + j], back[:, :, j * dim : (j + 1) * dim])
        return grads

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 400, batch: int = 128, rate: float = 4e-3) -> ByteConvNet:
        return self._adam(x, y, (self.rng.integers(0, len(x), batch) for _ in range(steps)), steps, rate)

    def epoch(self, x: np.ndarray, y: np.ndarray, batch: int = 128, rate: float = 1e-3, seed=0) -> ByteConvNet:
        """Go on from the present weights with every row once, in an order drawn from ``seed``."""
        order = np.random.default_rng(seed).permutation(len(x))
        steps = -(-len(x) // batch)
        return self._adam(x, y, (order[k::steps] for k in range(steps)), steps, rate)

    def _adam(self, x: np.ndarray, y: np.ndarray, picks, steps: int, rate: float) -> ByteConvNet:
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for t, pick in enumerate(picks, 1):
            lr = rate * (1 - 0.9 * t / steps)
            for k, g in self._step(x[pick], y[pick]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                self.p[k] -= (lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self

    def tables(self) -> ByteConvNet:
        """Multiply out what prediction looks up; part of the model that is sent to tasks."""
        dim, self.t = self.p["emb"].shape[1], {}
        for w in self.widths:
            taps = [self.p["emb"] @ self.p[f"k{w}"][j * dim : (j + 1) * dim] for j in range(w)]
            taps[0] = taps[0] + self.p[f"c{w}"]
            pairs = [(taps[j][:, None] + taps[j + 1][None]).reshape(65536, -1) for j in range(0, w - 1, 2)]
            self.t[w] = pairs + ([taps[-1]] if w % 2 else [])
        return self

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("t", "rng")}

    def logits(self, x: np.ndarray, chunk: int = 256) -> np.ndarray:
        """Class scores of windows (rows of bytes)."""
        if not hasattr(self, "t"):
            self.tables()
        out = np.empty((len(x), len(self.p["bias"])), np.float32)
        for at in range(0, len(x), chunk):
            b = x[at : at + chunk]
            two = (b[:, :-1].astype(np.int32) << 8) | b[:, 1:]
            pooled = []
            for w in self.widths:
                n = x.shape[1] - w + 1
                z = self.t[w][0].take(two[:, :n], axis=0)
                for k, tab in enumerate(self.t[w][1:], 1):
                    z += tab.take((two if len(tab) > 256 else b)[:, 2 * k : 2 * k + n], axis=0)
                pooled.append(z.max(axis=1))
            out[at : at + chunk] = np.maximum(np.concatenate(pooled, axis=1), 0) @ self.p["out"] + self.p["bias"]
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)
