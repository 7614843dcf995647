"""Toxicity by a bidirectional gated recurrent network with attention pooling (operator 10).

A word enters as the learned vector of its place in a vocabulary (rare words
share one) beside the maximum over the learned vectors of its hashed character
trigrams, so that variants of a word meet. Gated recurrent units read a window
of words both ways, attention pools their states, and a logistic output scores
the window. A window begins at every word of a text; the highest score counts.
Everything is trained here in numpy.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame

from sextant.llm.common import chunks
from sextant.llm.labelled import sample
from sextant.llm.vectext import alnum_words, joined, mixed, ragged, span_hashes

WINDOW = 8
DIMS, STATE, ATTEND, GRAM_BITS = 8, 8, 8, 16
#: Labelled documents of each class that fitting reads at most.
PER_CLASS = 1000
#: Documents of the sample that a word must be in to have a place of its own, and the most places.
SEEN, VOCABULARY = 3, 20_000
#: Windows that are worked out at once.
BLOCK = 2048


class Tokens:
    """Words of many texts: hash, trigram rows (first[i] .. first[i+1]), and where texts begin."""

    def __init__(self, texts: list[str]):
        _, cp, at = joined(["", *(t.lower() for t in texts)])
        start, end = alnum_words(cp)
        self.hash = span_hashes(cp, start, end)
        plain = np.full(len(cp) + 1, 32, np.uint64)
        where = ragged(start, end - start)
        plain[where] = cp[where]
        m = np.uint64(0x9E3779B97F4A7C15)
        gram = mixed((plain[:-2] * m + plain[1:-1]) * m + plain[2:]) >> np.uint64(64 - GRAM_BITS)
        size = end - start
        self.gram = gram[ragged(start - 1, size)].astype(np.int32)
        self.first = np.concatenate(([0], np.cumsum(size)))
        self.at = np.searchsorted(start, at[1:])

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Word positions of every window (-1: past a short text's end), and the text of each.

        Windows begin at every word; the last one ends with its text. A text of
        fewer words has one window, a text without words an empty one."""
        n = np.diff(self.at)
        count = np.maximum(1, n - WINDOW + 1)
        doc = np.repeat(np.arange(len(n)), count)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        place = k[:, None] + np.arange(WINDOW)[None, :]
        return np.where(place < n[doc][:, None], place + self.at[doc][:, None], -1).astype(np.int32), doc


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """By the hyperbolic tangent, which has no overflow and one pass less than the exponential."""
    out = np.multiply(x, 0.5)
    np.tanh(out, out=out)
    out *= 0.5
    out += 0.5
    return out


def _by_row(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows and the sum of each one's values."""
    order = np.argsort(row, kind="stable")
    first = np.flatnonzero(np.diff(row[order], prepend=-1))
    return row[order][first], np.add.reduceat(value[order], first)


class ToxicityModel:
    def __init__(self, vocabulary: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.vocabulary = np.sort(vocabulary.astype(np.uint64))
        put = lambda *shape, s=0.3: rng.normal(0, s, shape).astype(np.float32)
        self.p = {"word": put(len(vocabulary) + 1, DIMS, s=0.1), "gram": put(1 << GRAM_BITS, DIMS, s=0.1), "attend": put(2 * STATE, ATTEND), "query": put(ATTEND), "out": put(2 * STATE), "bias": np.full(1, -1, np.float32)}
        for d in "fb":
            self.p |= {f"in_{d}": put(2 * DIMS, 3 * STATE), f"rec_{d}": put(STATE, 3 * STATE), f"b_{d}": np.zeros(3 * STATE, np.float32)}
        self.scale, self.shift = 1.0, 0.0

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's place in the vocabulary, or the last place for all others."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        i = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[i] == hashes, i, len(self.vocabulary))

    def _inputs(self, word: np.ndarray, gram: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not len(word):
            return np.zeros((0, 2 * DIMS), np.float32)
        return np.concatenate((self.p["word"][word], np.maximum.reduceat(self.p["gram"][gram], first[:-1])), axis=1)

    def _states(self, gates: np.ndarray, index: np.ndarray, d: str, keep: bool):
        """States of one direction, each step's own first; with keep also what going back needs."""
        rec, h = self.p[f"rec_{d}"], np.zeros((len(index), STATE), np.float32)
        out, kept = np.empty((WINDOW, len(index), STATE), np.float32), []
        for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
            g, r = gates[index[:, t]], h @ rec
            g[:, : 2 * STATE] += r[:, : 2 * STATE]
            zr = _sigmoid(g[:, : 2 * STATE])
            z, q = zr[:, :STATE], zr[:, STATE:]
            n = q * r[:, 2 * STATE :]
            n += g[:, 2 * STATE :]
            np.tanh(n, out=n)
            if keep:
                kept.append((t, h, z, q, n, r[:, 2 * STATE :]))
            h = h - n
            h *= z
            h += n
            out[t] = h
        return out, kept

    def _gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """What each word adds to the gates of either direction, and a last row for a step without a word."""
        out = {}
        for d in "fb":
            out[d] = np.zeros((len(x) + 1, 3 * STATE), np.float32)
            out[d][:-1] = x @ self.p[f"in_{d}"] + self.p[f"b_{d}"]
            out[d][-1, :STATE] = 30  # the state stays as it is
        return out

    def _forward(self, gates: dict[str, np.ndarray], index: np.ndarray, keep: bool = False):
        """Logits of windows; index are words, -1 for none."""
        p, states, kept = self.p, [], {}
        for d in "fb":
            s, kept[d] = self._states(gates[d], index, d, keep)
            states.append(s)
        h = np.concatenate(states, axis=2)
        u = np.tanh(h @ p["attend"])
        e = np.where(index.T >= 0, u @ p["query"], np.float32(-1e9))
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        c = np.einsum("tb,tbk->bk", a, h)
        return c @ p["out"] + p["bias"][0], (h, u, a, c, kept)

    def _gradients(self, word, gram, first, index, target, weight):
        """Gradients of the dense weights, and (rows, gradients) of the two tables."""
        p = self.p
        x = self._inputs(word, gram, first)
        logit, (h, u, a, c, kept) = self._forward(self._gates(x), index, keep=True)
        dl = ((_sigmoid(logit) - target) * weight).astype(np.float32)
        g = {"out": c.T @ dl, "bias": dl.sum(keepdims=True)}
        dc = dl[:, None] * p["out"]
        da = np.einsum("bk,tbk->tb", dc, h)
        dh = a[:, :, None] * dc[None]
        de = a * (da - (a * da).sum(0))
        g["query"] = np.einsum("tb,tbk->k", de, u)
        du = de[:, :, None] * p["query"] * (1 - u * u)
        g["attend"] = h.reshape(-1, 2 * STATE).T @ du.reshape(-1, ATTEND)
        dh += du @ p["attend"].T
        dx = np.zeros((len(x), 2 * DIMS), np.float32)
        for d, side in (("f", slice(0, STATE)), ("b", slice(STATE, 2 * STATE))):
            rec, back = p[f"rec_{d}"], np.zeros((len(index), STATE), np.float32)
            g[f"rec_{d}"], steps = np.zeros_like(rec), np.empty((WINDOW, len(index), 3 * STATE), np.float32)
            for t, before, z, q, n, rn in reversed(kept[d]):
                s = dh[t, :, side] + back
                dn = s * (1 - z) * (1 - n * n)
                dz = s * (before - n) * z * (1 - z)
                dq = dn * rn * q * (1 - q)
                step = np.concatenate((dz, dq, dn), axis=1)
                inner = np.concatenate((dz, dq, dn * q), axis=1)
                g[f"rec_{d}"] += before.T @ inner
                back = s * z + inner @ rec.T
                steps[t] = step
            flat = index.T.ravel()
            dg = np.zeros((len(x), 3 * STATE), np.float32)
            dg[flat[flat >= 0]] = steps.reshape(-1, 3 * STATE)[flat >= 0]  # each word is in one window of the batch
            g[f"in_{d}"], g[f"b_{d}"] = x.T @ dg, dg.sum(0)
            dx += dg @ p[f"in_{d}"].T
        size = np.diff(first)
        most = p["gram"][gram] == np.repeat(x[:, DIMS:], size, axis=0)
        rows = {"word": _by_row(word, dx[:, :DIMS]), "gram": _by_row(gram, most * np.repeat(dx[:, DIMS:], size, axis=0))}
        return g, rows

    def _sliding(self, gates: dict[str, np.ndarray], word: np.ndarray) -> np.ndarray:
        """Logits of the windows that begin at each of these words but the last few; gates are by kind of word, word the kinds.

        The same sums as _forward's. Features are rows and windows columns, so a
        step's words are a slice, not a gather. The halves are those of the sigmoid."""
        p, half = self.p, np.repeat(np.float32([0.5, 1]), (2 * STATE, STATE))
        sides = []
        for d, order in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
            g = gates[d] * half
            started = np.tanh(g[:, 2 * STATE :]) * (0.5 - 0.5 * np.tanh(g[:, :STATE]))  # the state after one word
            sides.append((order, np.concatenate((g, started), axis=1), np.ascontiguousarray((p[f"rec_{d}"] * half).T)))
        attend, out = np.ascontiguousarray(p["attend"].T), np.empty(max(0, len(word) - WINDOW + 1), np.float32)
        for a in range(0, len(out), BLOCK):
            n = min(BLOCK, len(out) - a)
            h = np.empty((WINDOW, 2 * STATE, n), np.float32)
            for side, (order, table, rec) in enumerate(sides):
                own, state = np.ascontiguousarray(table[word[a : a + n + WINDOW - 1]].T), h[:, side * STATE : (side + 1) * STATE]
                state[order[0]] = own[3 * STATE :, order[0] : order[0] + n]
                for before, t in zip(order, order[1:], strict=False):
                    r = rec @ state[before]
                    zq, s = r[: 2 * STATE], r[2 * STATE :]
                    zq += own[: 2 * STATE, t : t + n]
                    np.tanh(zq, out=zq)
                    zq *= 0.5
                    zq += 0.5
                    s *= zq[STATE:]
                    s += own[2 * STATE : 3 * STATE, t : t + n]
                    np.tanh(s, out=s)
                    np.subtract(state[before], s, out=state[t])
                    state[t] *= zq[:STATE]
                    state[t] += s
            u = attend @ h
            np.tanh(u, out=u)
            e = p["query"] @ u
            e -= e.max(0)
            np.exp(e, out=e)
            out[a : a + n] = (e * (p["out"] @ h)).sum(0) / e.sum(0) + p["bias"][0]
        return out

    def _logits(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """The logit of every window, in the order of windows(), and the text of each."""
        hashes, some, word = np.unique(tokens.hash, return_index=True, return_inverse=True)
        size = np.diff(tokens.first)[some]
        first = np.concatenate(([0], np.cumsum(size)))
        gates = self._gates(self._inputs(self.places(hashes), tokens.gram[ragged(tokens.first[some], size)], first))
        n = np.diff(tokens.at)
        count = np.maximum(1, n - WINDOW + 1)
        doc = np.repeat(np.arange(len(n)), count)
        out = np.empty(len(doc), np.float32)
        # the words of long texts lie end to end: windows over a border are worked out and dropped
        long = n >= WINDOW
        begins = ragged((np.cumsum(n * long) - n * long)[long], count[long])
        out[long[doc]] = self._sliding(gates, word[np.repeat(long, n)])[begins]
        few = n[~long][:, None] > np.arange(WINDOW)[None, :]
        index = np.full(few.shape, -1)
        index[few] = word[np.repeat(~long, n)]
        short = [self._forward(gates, index[a : a + BLOCK])[0] for a in range(0, len(index), BLOCK)]
        out[~long[doc]] = np.concatenate([np.zeros(0, np.float32), *short])
        return out, doc

    @classmethod
    def fit(cls, texts: list[str], labels: list[int], prior: float = 0.5, seed: int = 11, rounds: int = 12, steps: int = 30, batch: int = 256) -> ToxicityModel:
        """Fit to documents' labels alone.

        The first rounds learn from random windows with their document's label;
        the later ones from the highest windows, as the model then stands, of a
        third of the documents each time, clean ones too. With fewer than two classes every score
        is the prior."""
        prior = min(max(prior, 1e-3), 1 - 1e-3)
        if len(set(labels)) < 2:
            model = cls(np.zeros(0, np.uint64))
            model.scale, model.shift = 0.0, float(np.log(prior / (1 - prior)))
            return model
        rng = np.random.default_rng(seed)
        parts = [Tokens(texts[a:b]) for a, b in chunks([len(t) for t in texts])]
        seen: Counter = Counter()
        for t in parts:
            for a, b in zip(t.at, t.at[1:], strict=False):
                seen.update(np.unique(t.hash[a:b]).tolist())
        common = [h for h, n in sorted(seen.items(), key=lambda x: (-x[1], x[0])) if n >= SEEN][:VOCABULARY]
        model = cls(np.array(common, np.uint64), seed)
        y = np.array(labels, np.float32)
        balance = 0.5 / np.where(y == 1, y.mean(), 1 - y.mean())
        offset = np.concatenate(([0], np.cumsum([len(t.at) - 1 for t in parts])))
        made = [t.windows() for t in parts]
        part = np.concatenate([np.full(len(d), i) for i, (_, d) in enumerate(made)])
        local = np.concatenate([np.arange(len(d)) for _, d in made])
        doc = np.concatenate([d + offset[i] for i, (_, d) in enumerate(made)])
        places = [model.places(t.hash) for t in parts]
        m1 = {k: np.zeros_like(v) for k, v in model.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in model.p.items()}
        step = 0
        for r in range(rounds):
            if r < 5:
                weight = balance[doc] / np.bincount(doc)[doc]
                pick = rng.choice(len(doc), steps * batch, p=weight / weight.sum())
            else:
                looked = rng.permutation(len(parts))[: -(-len(parts) // 3)]
                logit = np.concatenate([model._logits(t)[0] if i in looked else np.full(len(made[i][1]), -np.inf) for i, t in enumerate(parts)])
                order = np.lexsort((-logit, doc))
                order = order[logit[order] > -np.inf]
                rank = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
                top = order[rank < np.where(y[doc[order]] == 1, 1, 3)]
                weight = balance[doc[top]] / np.where(y[doc[top]] == 1, 1, 3)
                pick = rng.choice(top, steps * batch, p=weight / weight.sum())
            pace = 1 - 0.9 * r / rounds
            for a in range(0, len(pick), batch):
                some = pick[a : a + batch]
                flat_word, flat_gram, size, index, base = [], [], [], np.full((len(some), WINDOW), -1), 0
                for row, w in enumerate(some):
                    t = parts[part[w]]
                    own = made[part[w]][0][local[w]]
                    own = own[own >= 0]
                    if not len(own):
                        continue
                    i, j = own[0], own[-1] + 1
                    flat_word.append(places[part[w]][i:j])
                    flat_gram.append(t.gram[t.first[i] : t.first[j]])
                    size.append(np.diff(t.first[i : j + 1]))
                    index[row, : j - i] = base + np.arange(j - i)
                    base += j - i
                if not base:
                    continue
                word = np.concatenate(flat_word)
                word = np.where(rng.random(len(word)) < 0.3, len(model.vocabulary), word)  # so that trigrams learn too
                first = np.concatenate(([0], np.cumsum(np.concatenate(size))))
                target = y[doc[some]]
                dense, tables = model._gradients(word, np.concatenate(flat_gram), first, index, target, np.full(len(some), 1 / len(some), np.float32))
                step += 1
                for k, v in dense.items():  # Adam
                    m1[k] += 0.1 * (v - m1[k])
                    m2[k] += 0.01 * (v * v - m2[k])
                    model.p[k] -= pace * 0.01 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-6)
                for k, (row, v) in tables.items():  # Adagrad, as most rows are rare
                    m2[k][row] += v * v
                    model.p[k][row] -= pace * 0.1 * v / (np.sqrt(m2[k][row]) + 1e-6)
        top = np.full(len(texts), -np.inf)
        np.maximum.at(top, doc, np.concatenate([model._logits(t)[0] for t in parts]))
        model._calibrate(top, y, np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean())))
        return model

    def _calibrate(self, top: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """A logistic curve from a document's highest logit to its probability, by Newton's method."""
        x, w = np.stack((top, np.ones_like(top)), axis=1), np.array([1.0, 0.0])
        for _ in range(30):
            q = _sigmoid(x @ w)
            hess = (x * (weight * q * (1 - q))[:, None]).T @ x + np.diag([0.5, 0.05])
            w = w - np.linalg.solve(hess, x.T @ (weight * (q - y)) + np.array([0.5, 0.05]) * (w - [1.0, 0.0]))
        self.scale, self.shift = float(max(w[0], 1e-3)), float(w[1])

    def score(self, texts: list[str]) -> np.ndarray:
        """The probability of label 1 of each whole text."""
        tokens = Tokens(texts)
        logit, doc = self._logits(tokens)
        top = np.full(len(texts), -np.inf)
        np.maximum.at(top, doc, logit)
        return _sigmoid(self.scale * top + self.shift)


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", per_class: int = PER_CLASS) -> ToxicityModel:
    """Fit on at most per_class labelled documents of each class where learn holds."""
    return ToxicityModel.fit(*sample(docs, labels, label, per_class, learn))
