"""A vectorised encoder for byte-pair vocabularies with word ends, exact to the tokenizers library.

Texts are cut into words by array operations; each distinct word is merged once
for many words together, and remembered by the worker within a bound.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cache

import numpy as np

from sextant.llm.vectext import LETTER, NUMBER, SPACE, _M2, classes, joined, ragged, span_hashes

#: Distinct words that a worker remembers; a matter of speed only.
REMEMBERED = 150_000
_NONE = np.int32(2**31 - 1)


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class _Pairs:
    """Rank of a pair of ids: hashed tables, each holding what collided in the one before."""

    SHIFT = np.uint64(44)

    def __init__(self, keys: np.ndarray):
        self.tables = []
        values, left, mult = np.arange(len(keys), dtype=np.int32), keys.astype(np.uint64), 0x9E3779B97F4A7C15
        while len(left):
            slot = (left * np.uint64(mult)) >> self.SHIFT
            _, first = np.unique(slot, return_index=True)
            held, value, more = np.full(1 << 20, 2**32 - 1, np.uint32), np.full(1 << 20, _NONE, np.int32), np.zeros(1 << 20, bool)
            held[slot[first]], value[slot[first]] = left[first], values[first]
            rest = np.ones(len(left), bool)
            rest[first] = False
            more[slot[rest]] = True
            self.tables.append((np.uint64(mult), held, value, more))
            left, values, mult = left[rest], values[rest], (mult * 0xD6E8FEB86659FD93 | 1) % 2**64

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.uint64) << np.uint64(16)) | b.astype(np.uint64)
        out, todo = np.full(len(key), _NONE, np.int32), slice(None)
        for mult, held, value, more in self.tables:
            some = key[todo]
            slot = (some * mult) >> self.SHIFT
            same = held[slot] == some
            where = np.arange(len(key)) if isinstance(todo, slice) else todo
            out[where[same]] = value[slot[same]]
            todo = where[more[slot] & ~same]
            if not len(todo):
                break
        return out


class WordBPE:
    """Encodes as ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` does.

    With special_text false, the strings of special tokens are ordinary text."""

    def __init__(self, path: str, special_text: bool = True):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        suffix = model["end_of_word_suffix"]
        assert model["type"] == "BPE" and suffix and len(vocab) <= 65536, "a BPE vocabulary with word ends of at most 65,536 ids"
        letters = _byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int32)
        self.final = np.array([vocab[x + suffix] for x in letters], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.pairs = _Pairs(np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint64))
        self.path = path
        self.specials = [t["content"] for t in spec["added_tokens"]] if special_text else []
        self._full = None
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint16)
        self.used = 0
        self.at, self.length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _slow(self, text: str) -> np.ndarray:
        if self._full is None:
            from tokenizers import Tokenizer

            self._full = Tokenizer.from_file(self.path)
        return np.array(self._full.encode(text, add_special_tokens=False).ids, np.uint16)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of non-empty words, one after another, and how many each has."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[raw]
        last = np.cumsum(size) - 1
        sym[last] = self.final[raw[last]]
        word = np.repeat(np.arange(len(words)), size)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            inside = np.empty(len(word), bool)
            inside[-1] = False
            np.equal(word[1:], word[:-1], out=inside[:-1])
            rank = np.full(len(sym), _NONE, np.int32)
            here = np.flatnonzero(inside)
            rank[here] = self.pairs.rank(sym[here], sym[here + 1])
            first = np.flatnonzero(np.concatenate(([True], ~inside[:-1])))
            best = np.minimum.reduceat(rank, first)
            count = np.diff(np.append(first, len(sym)))
            best_at = np.repeat(best, count)
            settled = best_at == _NONE
            if settled.any():
                done.append((word[settled], sym[settled]))
                sym, word, rank, best_at = (x[~settled] for x in (sym, word, rank, best_at))
                if not len(sym):
                    break
            hit = rank == best_at
            twice = hit[1:] & hit[:-1]
            if twice.any():  # of overlapping pairs the left one goes first
                for i in np.flatnonzero(twice):
                    if hit[i] and word[i] == word[i + 1]:
                        hit[i + 1] = False
            at = np.flatnonzero(hit)
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, word = sym[keep], word[keep]
        word, sym = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.uint16), np.bincount(word, minlength=len(words))

    def _learn(self, words: list[str]) -> None:
        for a in range(0, len(words), 50_000):
            some = words[a : a + 50_000]
            ids, count = self.merge([w.encode("utf-8", "surrogatepass") for w in some])
            n = len(self.known)
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
            while n + len(some) > len(self.at):
                self.at, self.length = (np.concatenate((x, np.zeros_like(x))) for x in (self.at, self.length))
            self.flat[self.used : self.used + len(ids)] = ids
            self.at[n : n + len(some)] = self.used + np.cumsum(count) - count
            self.length[n : n + len(some)] = count
            self.used += len(ids)
            self.known.update(zip(some, range(n, n + len(some)), strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's start (one more entry: the end)."""
        special = [i for i, t in enumerate(texts) if any(s in t for s in self.specials)]
        if special:
            parts = [self._slow(texts[i]) if i in special else None for i in range(len(texts))]
            rest, ends = self.encode(["" if p is not None else t for p, t in zip(parts, texts, strict=True)])
            parts = [rest[ends[i] : ends[i + 1]] if p is None else p for i, p in enumerate(parts)]
            return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        plain = []
        for t in texts:
            if not t.isascii():
                t = unicodedata.normalize("NFC", t).replace("Σ", "σ")
            plain.append(t.lower())
        whole, cp, starts = joined(plain)
        start, end = self.cut(cp)
        if not len(start):
            return np.zeros(0, np.uint16), np.zeros(len(texts) + 1, np.int64)
        h = span_hashes(cp, start, end)
        _, first, back = np.unique(h, return_index=True, return_inverse=True)
        if not (np.array_equal((end - start)[first][back], end - start) and np.array_equal((g := span_hashes(cp, start, end, _M2))[first][back], g)):
            first = back = np.arange(len(start))  # two words with one hash: take each by itself
        if len(self.known) > REMEMBERED:
            self._forget()
        words = [whole[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        self._learn([w for w in dict.fromkeys(words) if w not in self.known])
        index = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[back]
        length = self.length[index]
        total = np.concatenate(([0], np.cumsum(length)))
        return self.flat[ragged(self.at[index], length)], total[np.searchsorted(start, starts)]

    @staticmethod
    def cut(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each word: contractions, runs of letters, single numbers, runs of other signs."""
        c = classes()[cp]
        new = np.empty(len(c), bool)
        new[:1] = True
        np.not_equal(c[1:], c[:-1], out=new[1:])
        new |= c == NUMBER
        quote = np.flatnonzero((cp[:-2] == 39) & new[:-2] & (c[1:-1] == LETTER))
        if len(quote):
            x, y = cp[quote + 1], cp[quote + 2]
            one = np.isin(x, [ord(k) for k in "stmd"])
            two = ((x == ord("r")) | (x == ord("v"))) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))
            for sel, n in ((quote[one], 1), (quote[two], 2)):
                new[sel + 1] = False
                new[sel + 1 + n] = True
        at = np.flatnonzero(new)
        end = np.append(at[1:], len(cp))
        solid = c[at] != SPACE
        return at[solid], end[solid]


@cache
def encoder(path: str, special_text: bool = True) -> WordBPE:
    """This worker's encoder, kept from one task to the next."""
    return WordBPE(path, special_text)
