"""A character-level bidirectional LSTM with CRF transitions, in numpy: training from labelled spans, and decoding.

Labels are "outside" and, for each kind, "first" and "inside"; an inside label only follows its own kind, or the
window's start, for a window may cut a span. Both directions run as one stacked product. The parameters have a fixed
size, about 30,000 numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Characters are known as padding, printable ASCII (white space is a space), and any other.
N_CHARS = 97
_TABLE = np.full(128, 96, np.int16)
_TABLE[32:127] = np.arange(1, 96)
_TABLE[[9, 10, 11, 12, 13]] = 1


def ids(text: str) -> np.ndarray:
    at = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(at < 128, _TABLE[np.minimum(at, 127)], 96)


@dataclass
class Tagger:
    """x: (direction, character, gates); u: (direction, hidden, gates); b; w: (direction, hidden, label); e; a: transitions; s: starts. Gates: input, forget, output, new."""

    x: np.ndarray
    u: np.ndarray
    b: np.ndarray
    w: np.ndarray
    e: np.ndarray
    a: np.ndarray
    s: np.ndarray

    NAMES = ("x", "u", "b", "w", "e", "a", "s")

    @property
    def kinds(self) -> int:
        return len(self.e) // 2

    def allowed(self) -> np.ndarray:
        """Which label may follow which."""
        out = np.ones((len(self.e), len(self.e)), bool)
        for k in range(self.kinds):
            out[:, 2 + 2 * k] = False
            out[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
        return out

    def forward(self, windows: np.ndarray, keep: bool = False):
        """Emissions (time, window, label) of windows of character ids, and what the backward pass needs."""
        n, steps = windows.shape
        hidden = self.u.shape[1]
        both = np.stack([windows.T, windows.T[::-1]])  # (direction, time, window)
        h, c = np.zeros((2, n, hidden), np.float32), np.zeros((2, n, hidden), np.float32)
        hs, kept = np.zeros((steps + 1, 2, n, hidden), np.float32), []
        for t in range(steps):
            z = np.matmul(h, self.u)
            z += self.b[:, None]
            z[0] += self.x[0][both[0, t]]
            z[1] += self.x[1][both[1, t]]
            z[..., : 3 * hidden] *= 0.5
            np.tanh(z, out=z)
            z[..., : 3 * hidden] *= 0.5
            z[..., : 3 * hidden] += 0.5
            i, f, o, g = (z[..., k * hidden : (k + 1) * hidden] for k in range(4))
            last, c = c, f * c + i * g
            r = np.tanh(c)
            h = o * r
            hs[t + 1] = h
            if keep:
                kept.append((z, last, r))
        own, back = hs[1:, 0], hs[:0:-1, 1]
        return own @ self.w[0] + back @ self.w[1] + self.e, (both, hs, kept)

    def decode(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best labels (window, time) by Viterbi, and by how much each step's emission beats "outside"."""
        em, _ = self.forward(windows)
        steps, n, _ = em.shape
        a = np.where(self.allowed(), self.a, -1e4)
        score, came = self.s + em[0], np.zeros(em.shape, np.int8)
        for t in range(1, steps):
            to = score[:, :, None] + a
            came[t] = to.argmax(1)
            score = to.max(1) + em[t]
        out = np.zeros((n, steps), np.int8)
        out[:, -1] = score.argmax(1)
        for t in range(steps - 1, 0, -1):
            out[:, t - 1] = came[t][np.arange(n), out[:, t]]
        gain = np.take_along_axis(em.transpose(1, 0, 2), out[..., None].astype(np.int64), 2)[..., 0] - em[..., 0].T
        return out, gain

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean negative log likelihood a step, and its gradients."""
        em, (both, hs, kept) = self.forward(windows, keep=True)
        steps, n, count = em.shape
        gold = labels.T
        # forward and backward sums of the CRF, scaled at each step
        ea = np.where(self.allowed(), np.exp(self.a), 0).astype(np.float64)
        top = em.max(2, keepdims=True)
        p = np.exp(em - top).astype(np.float64)
        alpha, scale, beta = np.zeros(em.shape), np.zeros((steps, n, 1)), np.ones(em.shape)
        for t in range(steps):
            v = (np.exp(self.s) if t == 0 else alpha[t - 1] @ ea) * p[t]
            scale[t] = v.sum(1, keepdims=True)
            alpha[t] = v / scale[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = (p[t + 1] * beta[t + 1]) @ ea.T / scale[t + 1]
        at = np.ix_(range(steps), range(n))
        path = em[at[0], at[1], gold].sum() + self.s[gold[0]].sum() + self.a[gold[:-1], gold[1:]].sum()
        loss = (np.log(scale) + top).sum() - path
        de = alpha * beta
        de[at[0], at[1], gold] -= 1
        ds = de[0].sum(0)
        da = ea * np.einsum("tni,tnj->ij", alpha[:-1], p[1:] * beta[1:] / scale[1:])
        np.subtract.at(da, (gold[:-1].ravel(), gold[1:].ravel()), 1)
        da *= self.allowed()
        # through the emissions and back through time
        de = (de / (n * steps)).astype(np.float32)
        hidden = self.u.shape[1]
        own, back = hs[1:, 0], hs[:0:-1, 1]
        grads = {"a": da / (n * steps), "s": ds / (n * steps), "e": de.sum((0, 1)), "w": np.stack([np.einsum("tnh,tnl->hl", v, de, optimize=True) for v in (own, back)])}
        dh_out = np.stack([de @ self.w[0].T, (de @ self.w[1].T)[::-1]], axis=1)
        dz, dh, dc = np.zeros((steps, 2, n, 4 * hidden), np.float32), 0.0, 0.0
        ut = self.u.transpose(0, 2, 1)
        for t in range(steps - 1, -1, -1):
            z, last, r = kept[t]
            i, f, o, g = (z[..., k * hidden : (k + 1) * hidden] for k in range(4))
            dh = dh + dh_out[t]
            dc = dc + dh * o * (1 - r * r)
            d = dz[t]
            d[..., :hidden] = dc * g * i * (1 - i)
            d[..., hidden : 2 * hidden] = dc * last * f * (1 - f)
            d[..., 2 * hidden : 3 * hidden] = dh * r * o * (1 - o)
            d[..., 3 * hidden :] = dc * i * (1 - g * g)
            dh, dc = np.matmul(d, ut), dc * f
        flat = dz.transpose(1, 0, 2, 3).reshape(2, steps * n, 4 * hidden)
        before = hs[:-1].transpose(1, 0, 2, 3).reshape(2, steps * n, hidden)
        grads["u"], grads["b"] = np.matmul(before.transpose(0, 2, 1), flat), flat.sum(1)
        grads["x"] = np.zeros_like(self.x)
        for k in range(2):
            hot = np.zeros((steps * n, N_CHARS), np.float32)
            hot[np.arange(steps * n), both[k].ravel()] = 1
            grads["x"][k] = hot.T @ flat[k]
        return float(loss) / (n * steps), grads


def fresh(kinds: int, hidden: int, draw: np.random.Generator) -> Tagger:
    normal = lambda *shape, scale: (draw.standard_normal(shape) * scale).astype(np.float32)
    b = np.zeros((2, 4 * hidden), np.float32)
    b[:, hidden : 2 * hidden] = 1
    n = 1 + 2 * kinds
    return Tagger(normal(2, N_CHARS, 4 * hidden, scale=0.3), normal(2, hidden, 4 * hidden, scale=hidden**-0.5), b, normal(2, hidden, n, scale=hidden**-0.5), np.zeros(n, np.float32), np.zeros((n, n), np.float32), np.zeros(n, np.float32))


def train(samples: list[tuple[str, list[tuple[int, int, int]]]], kinds: int, window: int, hidden: int = 32, steps: int = 500, batch: int = 48, rate: float = 0.012, seed: int = 13) -> Tagger:
    """A tagger from (text, spans of (kind, start, end)): each step takes windows cut at random places of random samples, some beyond their ends."""
    draw = np.random.default_rng(seed)
    model = fresh(kinds, hidden, draw)
    marked = []
    for text, spans in samples:
        labels = np.zeros(len(text), np.int64)
        for kind, start, end in spans:
            labels[start:end] = 2 + 2 * kind
            labels[start] = 1 + 2 * kind
        marked.append((ids(text), labels))
    m, v = ({k: np.zeros_like(getattr(model, k)) for k in Tagger.NAMES} for _ in range(2))
    for step in range(1, steps + 1):
        x, y = np.zeros((batch, window), np.int64), np.zeros((batch, window), np.int64)
        for j, at in enumerate(draw.integers(0, len(marked), batch)):
            chars, labels = marked[at]
            lo = int(draw.integers(0, max(1, len(chars) - window // 3)))
            part = slice(lo, lo + window)
            x[j, : len(chars[part])], y[j, : len(chars[part])] = chars[part], labels[part]
        _, grads = model.gradients(x, y)
        size = max(1.0, float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in grads.values()))) / 0.25)
        now = rate * min(1.0, step / 20) * (0.02 + 0.98 * (1 + np.cos(np.pi * step / steps)) / 2)
        for k in Tagger.NAMES:
            g = (grads[k] / size).astype(np.float32)
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            setattr(model, k, (getattr(model, k) - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32))
    return model
