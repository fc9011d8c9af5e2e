"""A bidirectional gated recurrent network with attention pooling, in numpy: forward, backward, Adam."""

from __future__ import annotations

import numpy as np

F = np.float32


def sigmoid(x: np.ndarray) -> np.ndarray:
    return F(0.5) * np.tanh(F(0.5) * x) + F(0.5)


class Network:
    """Windows of inputs to one logit each. `mask` is 1 where a window has a word; None if all are full."""

    def __init__(self, inputs: int, hidden: int = 8, attention: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(F)
        self.hidden, self.p = hidden, {}
        for side in "fb":  # forwards and backwards
            self.p |= {f"{side}x": draw(inputs, 3 * hidden), f"{side}b": np.zeros(3 * hidden, F), f"{side}g": draw(hidden, 2 * hidden), f"{side}n": draw(hidden, hidden)}
        self.p |= {"ax": draw(2 * hidden, attention), "ab": np.zeros(attention, F), "av": draw(attention), "o": draw(2 * hidden), "ob": np.zeros(1, F)}

    def projected(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """What the inputs add to the gates: once for each distinct word."""
        return {s: x.astype(F) @ self.p[s + "x"] + self.p[s + "b"] for s in "fb"}

    def _run(self, side: str, pre: list[np.ndarray], mask, keep: list | None) -> list[np.ndarray]:
        k, g, n = self.hidden, self.p[side + "g"], self.p[side + "n"]
        h, out = np.zeros((len(pre[0]), k), F), [None] * len(pre)
        for t in range(len(pre)) if side == "f" else range(len(pre) - 1, -1, -1):
            gates = sigmoid(pre[t][:, : 2 * k] + h @ g)
            z, r = gates[:, :k], gates[:, k:]
            new = np.tanh(pre[t][:, 2 * k :] + (r * h) @ n)
            step = h + z * (new - h)
            if mask is not None:
                step = np.where(mask[:, t, None] > 0, step, h)
            if keep is not None:
                keep.append((t, h, z, r, new))
            h = out[t] = step
        return out

    def _pool(self, states: np.ndarray, mask):
        u = np.tanh(states @ self.p["ax"] + self.p["ab"])
        e = u @ self.p["av"]
        if mask is not None:
            e = np.where(mask > 0, e, F(-1e9))
        a = np.exp(e - e.max(1, keepdims=True))
        if mask is not None:
            a = a * mask
        a = a / np.maximum(a.sum(1, keepdims=True), F(1e-9))
        pooled = np.einsum("nt,nth->nh", a, states)
        return u, a, pooled, pooled @ self.p["o"] + self.p["ob"][0]

    def logits(self, projected: dict[str, np.ndarray], places: np.ndarray, mask=None) -> np.ndarray:
        """places: (windows, words) rows of the projected inputs."""
        sides = [np.stack(self._run(s, [projected[s][places[:, t]] for t in range(places.shape[1])], mask, None), axis=1) for s in "fb"]
        return self._pool(np.concatenate(sides, axis=2), mask)[3]

    def gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean logistic loss and its gradient; x: (windows, words, inputs)."""
        n, steps, _ = x.shape
        k, p, grad, kept, sides = self.hidden, self.p, {}, {"f": [], "b": []}, []
        for s in "fb":
            pre = x @ p[s + "x"] + p[s + "b"]
            sides.append(np.stack(self._run(s, [pre[:, t] for t in range(steps)], mask, kept[s]), axis=1))
        states = np.concatenate(sides, axis=2)
        u, a, pooled, logit = self._pool(states, mask)
        prob = sigmoid(logit)
        loss = float((weight * (np.logaddexp(0, logit) - y * logit)).mean())
        d = (weight * (prob - y) / n).astype(F)
        grad["o"], grad["ob"] = pooled.T @ d, np.array([d.sum()], F)
        dp = d[:, None] * p["o"]
        da = np.einsum("nh,nth->nt", dp, states)
        ds = a[:, :, None] * dp[:, None, :]
        de = a * (da - (a * da).sum(1, keepdims=True))
        grad["av"] = np.einsum("nt,nta->a", de, u)
        du = de[:, :, None] * p["av"] * (1 - u * u)
        grad["ax"], grad["ab"] = np.einsum("nth,nta->ha", states, du), du.sum((0, 1))
        ds = ds + du @ p["ax"].T
        for i, s in enumerate("fb"):
            g, w = p[s + "g"], p[s + "n"]
            gx, gb, gg, gn = np.zeros_like(p[s + "x"]), np.zeros_like(p[s + "b"]), np.zeros_like(g), np.zeros_like(w)
            dh = np.zeros((n, k), F)
            for t, h, z, r, new in reversed(kept[s]):
                dh = dh + ds[:, t, i * k : (i + 1) * k]
                live = mask[:, t, None]
                step = dh * live
                dnew = step * z * (1 - new * new)
                rh = dnew @ w.T
                dz, dr = step * (new - h) * z * (1 - z), rh * h * r * (1 - r)
                dgates = np.concatenate([dz, dr], axis=1)
                dpre = np.concatenate([dgates, dnew], axis=1)
                gx += x[:, t].T @ dpre
                gb += dpre.sum(0)
                gg += h.T @ dgates
                gn += (r * h).T @ dnew
                dh = dh * (1 - live) + step * (1 - z) + rh * r + dgates @ g.T
            grad |= {s + "x": gx, s + "b": gb, s + "g": gg, s + "n": gn}
        return loss, grad

    def fit(self, x, y, weight, mask, epochs: int = 6, batch: int = 256, rate: float = 0.01, seed: int = 11) -> list[float]:
        rng, losses, step = np.random.default_rng(seed), [], 0
        m, v = ({n: np.zeros_like(a) for n, a in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            order, total = rng.permutation(len(y)), 0.0
            for i in range(0, len(y), batch):
                rows = order[i : i + batch]
                loss, grad = self.gradient(x[rows], y[rows], weight[rows], mask[rows])
                total, step = total + loss * len(rows), step + 1
                for n, d in grad.items():
                    m[n] += F(0.1) * (d - m[n])
                    v[n] += F(0.001) * (d * d - v[n])
                    self.p[n] -= F(rate) * (m[n] / F(1 - 0.9**step)) / (np.sqrt(v[n] / F(1 - 0.999**step)) + F(1e-8))
            losses.append(total / max(1, len(y)))
        return losses
