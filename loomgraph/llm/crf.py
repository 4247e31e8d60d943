"""A bidirectional LSTM with a linear-chain CRF on top, in numpy, for small alphabets and tag sets."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Lstm:
    """One direction: wx[symbol] holds a symbol's share of the four gates with the bias."""

    wx: np.ndarray
    u: np.ndarray

    def forward(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States [time, row, hidden] for symbols [row, time]; what backward needs, if asked to keep it."""
        rows, steps = x.shape
        n = self.u.shape[0]
        h = c = np.zeros((rows, n), np.float32)
        out, kept = np.empty((steps, rows, n), np.float32), []
        for t in range(steps):
            a = self.wx[x[:, t]] + h @ self.u
            gates = sigmoid(a[:, : 3 * n])
            i, f, o, g = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :], np.tanh(a[:, 3 * n :])
            before = h, c
            c = f * c + i * g
            tc = np.tanh(c)
            h = out[t] = o * tc
            if keep:
                kept.append((i, f, o, g, tc, *before))
        return out, kept

    def backward(self, x: np.ndarray, kept: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of wx and u."""
        dwx, du = np.zeros_like(self.wx), np.zeros_like(self.u)
        dh = dc = np.zeros_like(dout[0])
        for t in range(len(kept) - 1, -1, -1):
            i, f, o, g, tc, h, c = kept[t]
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - tc * tc)
            da = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
            du += h.T @ da
            dwx += np.eye(len(self.wx), dtype=np.float32)[x[:, t]].T @ da
            dh, dc = da @ self.u.T, dc * f
        return dwx, du


@dataclass
class Tagger:
    """ahead and back read the symbols in both directions; out and bias give tag scores; move[a, b] scores tag b after tag a."""

    ahead: Lstm
    back: Lstm
    out: np.ndarray
    bias: np.ndarray
    move: np.ndarray
    allowed: np.ndarray

    @classmethod
    def new(cls, symbols: int, hidden: int, allowed: np.ndarray, seed: int) -> Tagger:
        rng = np.random.default_rng(seed)
        tags = len(allowed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        sides = [Lstm(draw(symbols, 4 * hidden), draw(hidden, 4 * hidden)) for _ in range(2)]
        for s in sides:
            s.wx[:, hidden : 2 * hidden] += 1  # forget gates begin open
        return cls(*sides, draw(2 * hidden, tags), np.zeros(tags, np.float32), np.zeros((tags, tags), np.float32), allowed)

    def parameters(self) -> list[np.ndarray]:
        return [self.ahead.wx, self.ahead.u, self.back.wx, self.back.u, self.out, self.bias, self.move]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Tag scores [time, row, tag]."""
        states = np.concatenate([self.ahead.forward(x)[0], self.back.forward(x[:, ::-1])[0][::-1]], 2)
        return states @ self.out + self.bias

    def moves(self) -> np.ndarray:
        return np.where(self.allowed, self.move, np.float32(-1e4))

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tags [row, time] by Viterbi."""
        scores, moves = self.scores(x), self.moves()
        steps, rows, _ = scores.shape
        best, back = scores[0], np.empty((steps, rows, len(moves)), np.int8)
        for t in range(1, steps):
            total = best[:, :, None] + moves
            back[t] = total.argmax(1)
            best = total.max(1) + scores[t]
        tags = np.empty((rows, steps), np.int8)
        tags[:, -1] = best.argmax(1)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = back[t][np.arange(rows), tags[:, t]]
        return tags

    def gradients(self, x: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean negative log-likelihood of the tags and its gradients, in the order of parameters()."""
        (fa, ka), (fb, kb) = self.ahead.forward(x, True), self.back.forward(x[:, ::-1], True)
        states = np.concatenate([fa, fb[::-1]], 2)
        scores, moves = (states @ self.out + self.bias).astype(np.float64), self.moves().astype(np.float64)
        steps, rows, n = scores.shape
        alpha, beta = np.empty_like(scores), np.zeros_like(scores)
        alpha[0] = scores[0]
        total = lambda z, axis: (m := z.max(axis)) + np.log(np.exp(z - np.expand_dims(m, axis)).sum(axis))
        for t in range(1, steps):
            alpha[t] = total(alpha[t - 1][:, :, None] + moves, 1) + scores[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = total(moves + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
        norm = total(alpha[-1], 1)
        dscores = np.exp(alpha + beta - norm[None, :, None])
        dmove = np.zeros((n, n))
        for t in range(1, steps):
            dmove += np.exp(alpha[t - 1][:, :, None] + moves + (scores[t] + beta[t])[:, None, :] - norm[:, None, None]).sum(0)
        row, time = np.arange(rows)[None, :], np.arange(steps)[:, None]
        gold = scores[time, row, tags.T].sum(0) + moves[tags[:, :-1], tags[:, 1:]].sum(1)
        dscores[time, row, tags.T] -= 1
        np.add.at(dmove, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -1)
        d = (dscores / rows).astype(np.float32)
        dstates = d @ self.out.T
        h = self.ahead.u.shape[0]
        da = self.ahead.backward(x, ka, dstates[:, :, :h])
        db = self.back.backward(x[:, ::-1], kb, dstates[::-1, :, h:])
        grads = [*da, *db, np.einsum("tbh,tbk->hk", states, d), d.sum((0, 1)), np.where(self.allowed, dmove / rows, 0).astype(np.float32)]
        return float((norm - gold).mean()), grads

    def train(self, x: np.ndarray, tags: np.ndarray, epochs: int, rows: int = 64, rate: float = 0.02, seed: int = 0) -> list[float]:
        """Adam over shuffled batches; the mean loss of each epoch."""
        rng = np.random.default_rng(seed)
        own = self.parameters()
        first, second, step, losses = [np.zeros_like(p) for p in own], [np.zeros_like(p) for p in own], 0, []
        for epoch in range(epochs):
            order, sums = rng.permutation(len(x)), []
            for lo in range(0, len(order), rows):
                batch = order[lo : lo + rows]
                loss, grads = self.gradients(x[batch], tags[batch])
                sums.append(loss)
                step += 1
                scale = min(1.0, 5 / (np.sqrt(sum(float((g * g).sum()) for g in grads)) + 1e-9))
                speed = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
                for p, g, a, b in zip(own, grads, first, second, strict=True):
                    g = g * np.float32(scale)
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= (speed * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            losses.append(float(np.mean(sums)))
        return losses
