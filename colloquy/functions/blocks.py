"""Texts that meet others of a block: each asked text against all held ones, by whole-array steps.

A block is bounded by who makes it, and so are the arrays here. Nothing is made per pair but what a caller takes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from colloquy.functions.similarity import COUNTED, common_subsequence, similarity

#: Asked texts whose words are looked up together.
BATCH = 256
#: Pairs of one asked text from which they are handled side by side, its length up to which they are, and characters and words of bits side by side.
MANY, LONGEST, SIDE = 24, 4096, 1 << 20
#: Runs of characters: how many a pair of texts shares on average (which decides how long they are at least), positions looked at for that, starts of runs held at once, and blocks in a row that are found.
SHARED, LOOKED, STARTS, DEEP = 24, 1 << 16, 1 << 22, 8
_CODES = np.full(256, len(COUNTED), np.int64)
_CODES[np.frombuffer(COUNTED.encode(), np.uint8)] = np.arange(len(COUNTED))


def lengths(texts: pa.Array) -> np.ndarray:
    return pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)


def signatures(texts: pa.Array) -> np.ndarray:
    """Texts x counts, as ``similarity.signature`` has them."""
    data = [t.encode() for t in texts.to_pylist()]
    rows = np.repeat(np.arange(len(data)), np.fromiter(map(len, data), np.int64, len(data)))
    wide = len(COUNTED) + 1
    counts = np.bincount(rows * wide + _CODES[np.frombuffer(b"".join(data), np.uint8)], minlength=len(data) * wide).reshape(-1, wide)
    counts[:, -1] = lengths(texts) - counts[:, :-1].sum(1)
    return counts.astype(np.int32)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The text and the code of each word of texts, in order of the texts."""
    split = pc.split_pattern(texts, " ")
    codes = split.flatten().dictionary_encode()
    of = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    code = codes.indices.to_numpy(zero_copy_only=False)
    blank = pc.index(codes.dictionary, "").as_py()
    return (of, code) if blank < 0 else (of[code != blank], code[code != blank])


def meeting(asked: pa.Array, held: pa.Array, least: float, words: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """For each asked text its place, and the places of the held texts whose length allows a similarity of least and, if words, which share a word with it."""
    n, m = lengths(asked), lengths(held)
    order = np.argsort(m, kind="stable")
    ranked, sizes = m[order], np.unique(m)
    if words:
        of, code = _words(pa.concat_arrays([asked, held.take(pa.array(order))]))
        split = np.searchsorted(of, len(asked))
        of_held, code_held = of[split:] - len(asked), code[split:]
        at = np.searchsorted(of[:split], np.arange(len(asked) + 1))
        place = np.full(int(code.max(initial=-1)) + 1, -1)
    for i in range(len(asked)):
        if words and i % BATCH == 0:
            wanted = np.unique(code[at[i] : at[min(i + BATCH, len(asked))]])
            place[:] = -1
            place[wanted] = np.arange(len(wanted))
            where = place[code_held]
            where, who = where[where >= 0], of_held[where >= 0]
            bits = np.zeros((len(wanted), -(-len(held) // 8)), np.uint8)
            np.bitwise_or.at(bits, (where, who >> 3), (128 >> (who & 7)).astype(np.uint8))
        fits = sizes[2 * np.minimum(n[i], sizes) >= least * (n[i] + sizes)]
        if not len(fits):
            continue
        lo, hi = np.searchsorted(ranked, fits[0]), np.searchsorted(ranked, fits[-1], "right")
        if words:
            shared = np.bitwise_or.reduce(bits[place[code[at[i] : at[i + 1]]]], axis=0)
            yield i, order[lo + np.flatnonzero(np.unpackbits(shared)[lo:hi])]
        else:
            yield i, order[lo:hi]


def allowed(one: np.ndarray, many: np.ndarray, total: np.ndarray, least: float) -> np.ndarray:
    """Which of many signatures allow a similarity of least with one; total: the lengths of both texts."""
    return 2 * np.minimum(many, one).sum(1) >= least * total


class Characters:
    """Characters of held texts as codes of their own."""

    def __init__(self, texts: pa.Array):
        self.texts = texts.to_pylist()
        self.sizes = lengths(texts)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        points = np.frombuffer("".join(self.texts).encode("utf-32-le"), np.uint32)
        used = np.zeros(int(points.max(initial=0)) + 1, bool)
        used[points] = True
        self.alphabet = np.flatnonzero(used).astype(np.uint32)
        self.codes = (np.cumsum(used) - 1)[points]

    def common(self, text: str, rows: np.ndarray) -> np.ndarray:
        """Lengths of the longest common subsequences of text and the texts at rows, as ``common_subsequence`` has them."""
        if len(rows) < MANY or len(text) > LONGEST:
            return np.array([common_subsequence(text, self.texts[k]) for k in rows], np.int64)
        words = -(-len(text) // 64)
        step = max(1, SIDE // max(int(self.sizes[rows].max()), words))
        return np.concatenate([self._beside(text, words, rows[k : k + step]) for k in range(0, len(rows), step)])

    def _beside(self, text: str, words: int, rows: np.ndarray) -> np.ndarray:
        own = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = np.searchsorted(self.alphabet, own)
        known = np.flatnonzero(self.alphabet[np.minimum(at, len(self.alphabet) - 1)] == own)
        masks = np.zeros((words, len(self.alphabet) + 1), np.uint64)  # the last code pads
        np.bitwise_or.at(masks, (known >> 6, at[known]), np.uint64(1) << (known & 63).astype(np.uint64))
        size = self.sizes[rows]
        place = np.arange(size.max())[:, None]
        codes = np.where(place < size, self.codes[np.minimum(self.starts[rows] + place, len(self.codes) - 1)], len(self.alphabet))
        v = np.full((words, len(rows)), ~np.uint64(0))
        m, u, s = (np.empty_like(v) for _ in range(3))
        for code in codes:
            np.take(masks, code, axis=1, out=m, mode="clip")
            np.bitwise_and(v, m, out=u)
            np.add(v, u, out=s)
            carry = (s < u)[:-1]  # to the next word
            at = 1
            while at < words and carry.any():
                s[at:] += carry
                carry = (carry & (s[at:] == 0))[:-1]
                at += 1
            np.bitwise_xor(v, u, out=v)
            np.bitwise_or(v, s, out=v)
        return np.bitwise_count(~v).sum(0, dtype=np.int64)


class Runs:
    """Runs of characters that held texts share with an asked one, and how similar these leave them at most.

    The ratio's matching blocks are the longest common run, then those left and right of it. Common runs of at least
    ``size`` characters are found by their grams, for all held texts at once; so the first blocks are known, and what is
    left can match no more than the shorter of its two sides.
    """

    def __init__(self, texts: Characters, longest: int):
        """longest: length of the longest text that is asked for."""
        self.texts, bits = texts, max(1, len(texts.alphabet).bit_length())
        self.bits = bits
        middle = float(texts.sizes.mean()) if len(texts.sizes) else 0.0
        codes, some = texts.codes, np.arange(0, max(0, len(texts.codes) - 63), max(1, len(texts.codes) // LOOKED))
        looked = np.zeros(len(some), np.int64)
        for size in range(1, 63 // bits + 1):
            self.size = size
            looked = (looked << bits) | codes[some + size - 1]
            alike = np.unique(looked, return_counts=True)[1].astype(np.float64)
            if size > 1 and middle * middle * (alike * (alike - 1)).sum() <= SHARED * len(some) * max(0, len(some) - 1):
                break
        grams, row = self._grams(codes), np.repeat(np.arange(len(texts.sizes)), texts.sizes)
        place = np.flatnonzero(np.arange(len(grams)) + self.size <= texts.starts[1:][row[: len(grams)]])
        order = np.argsort(grams[place])
        place, self.grams = place[order], grams[place][order]
        # of a text's place i and a row's j: row * width + j - i + longest in the high bits and i in the low, so a run is a row of numbers
        self.longest, self.shift, self.width = longest, longest.bit_length(), longest + int(texts.sizes.max(initial=0)) + 1
        self.fits = self.width < 1 << 20 and (len(texts.sizes) + 1) * self.width < 1 << (62 - self.shift)
        self.key = (row[place] * self.width + place - texts.starts[row[place]] + longest) << self.shift if self.fits else place

    def _grams(self, codes: np.ndarray) -> np.ndarray:
        count = max(0, len(codes) - self.size + 1)
        out = np.zeros(count, np.int64)
        for k in range(self.size):
            out = (out << self.bits) | codes[k : k + count]
        return out

    def _shared(self, text: str, wanted: np.ndarray) -> tuple[np.ndarray, ...] | None:
        """(row, place in text, place in the row's text, length) of the runs that text shares with wanted rows, by rows; None if they are too many."""
        own = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        n, alphabet = len(own), self.texts.alphabet
        at = np.minimum(np.searchsorted(alphabet, own), len(alphabet) - 1)
        unknown = np.concatenate([[0], np.cumsum(alphabet[at] != own)])
        here = np.flatnonzero(unknown[self.size :] == unknown[: max(0, n - self.size + 1)]) if n >= self.size else np.zeros(0, np.int64)
        grams = self._grams(at)[here]
        lo = np.searchsorted(self.grams, grams)
        many = np.searchsorted(self.grams, grams, "right") - lo
        if not self.fits or many.sum() > STARTS:
            return None
        key = self.key[np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())]
        key += np.repeat(here - (here << self.shift), many)
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1] + 1])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(key))) + self.size - 1
        way, i = key[first] >> self.shift, key[first] & ((1 << self.shift) - 1)
        row = way // self.width
        kept = np.flatnonzero(wanted[row])
        return row[kept], i[kept], (way - row * self.width - self.longest + i)[kept], size[kept]

    def allowed(self, text: str, rows: np.ndarray, least: float) -> np.ndarray:
        """Those of rows whose texts may have a similarity of least with text."""
        wanted = np.zeros(len(self.texts.sizes), bool)
        wanted[rows] = True
        shared = self._shared(text, wanted)
        if shared is None:
            return rows
        run_row, run_i, run_j, run_size = shared
        first = np.flatnonzero(np.concatenate([[True], run_row[1:] != run_row[:-1]])) if len(run_row) else np.zeros(0, np.int64)
        end = np.append(first[1:], len(run_row))
        n, m = len(text), self.texts.sizes[rows]
        # the first block of each row
        rank = (run_size << 40) - (run_i << 20) - run_j  # the longest; of these the first in text, then in the other
        took = np.flatnonzero(rank == np.repeat(np.maximum.reduceat(rank, first), end - first)) if len(first) else first
        at = np.searchsorted(rows, run_row[took])
        i, j, size = run_i[took], run_j[took], run_size[took]
        likely = 2 * (size + np.minimum(i, j) + np.minimum(n - i - size, m[at] - j - size)) >= least * (n + m[at])
        alive = np.ones(len(rows), bool)
        alive[at[~likely]] = False
        at, begin, end, i, j, size = (x[likely] for x in (at, first, end, i, j, size))
        # from here per row with a first block: its characters in blocks, and the parts left and right of them
        rows_at, need, matched, none = at, least * (n + m[at]), size.copy(), np.zeros(len(at), np.int64)
        rest = none.copy()  # what parts without a block can match
        of = np.concatenate([np.arange(len(at))] * 2)
        parts = np.concatenate([np.stack([none, i, none, j]), np.stack([i + size, none + n, j + size, m[at]])], axis=1)
        open_ = (parts[1] > parts[0]) & (parts[3] > parts[2])
        of, parts = of[open_], parts[:, open_]
        shut_of, shut = [], []
        for _ in range(DEEP):
            many = end[of] - begin[of]
            part = np.repeat(np.arange(len(of)), many)
            run = np.arange(len(part)) + np.repeat(begin[of] - np.cumsum(many) + many, many)
            i, j, size = run_i[run], run_j[run], run_size[run]
            a0, a1, b0, b1 = parts[:, part]
            cut = np.maximum(0, np.maximum(a0 - i, b0 - j))
            i, j = i + cut, j + cut
            size = np.minimum(size - cut, np.minimum(a1 - i, b1 - j))
            fits = np.flatnonzero(size >= self.size)
            part, i, j, size = part[fits], i[fits], j[fits], size[fits]
            if not len(part):
                break
            rank = (size << 40) - (i << 20) - j
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            took = np.flatnonzero(rank == np.repeat(np.maximum.reduceat(rank, first), np.diff(np.append(first, len(part)))))
            part, i, j, size = part[took], i[took], j[took], size[took]
            closed = np.ones(len(of), bool)
            closed[part] = False
            shut_of.append(of[closed])
            shut.append(parts[:, closed])
            sides = np.minimum(parts[1] - parts[0], parts[3] - parts[2])
            rest += np.bincount(of[closed], sides[closed], len(rest)).astype(np.int64)
            matched += np.bincount(of[part], size, len(matched)).astype(np.int64)
            a0, a1, b0, b1 = parts[:, part]
            of, parts = np.concatenate([of[part]] * 2), np.concatenate([np.stack([a0, i, b0, j]), np.stack([i + size, a1, j + size, b1])], axis=1)
            sides = np.minimum(parts[1] - parts[0], parts[3] - parts[2])
            likely = 2 * (matched + rest + np.bincount(of, sides, len(rest)).astype(np.int64)) >= need
            alive[rows_at[~likely]] = False
            open_ = likely[of] & (parts[1] > parts[0]) & (parts[3] > parts[2])
            of, parts = of[open_], parts[:, open_]
            if not len(of):
                break
        of, parts = np.concatenate([*shut_of, of]), np.concatenate([*shut, parts], axis=1)
        open_ = alive[rows_at][of]
        of, parts = of[open_], parts[:, open_]
        alive[rows_at] &= 2 * (matched + np.bincount(of, self._alike(text, rows[rows_at[of]], parts), len(matched))) >= need
        return rows[alive]

    def _alike(self, text: str, rows: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """How many characters the parts (from, to in text; from, to in the row's text) have in common, in any order."""
        own = np.searchsorted(self.texts.alphabet, np.frombuffer(text.encode("utf-32-le"), np.uint32))
        wide = len(self.texts.alphabet) + 1
        known = np.minimum(own, wide - 2)
        own = np.where(self.texts.alphabet[known] == np.frombuffer(text.encode("utf-32-le"), np.uint32), known, wide - 1)
        out = np.zeros(len(rows), np.int64)
        step = max(1, SIDE // wide)
        for at in range(0, len(rows), step):
            some, counts = slice(at, at + step), []
            for codes, begin, size in ((own, parts[0], parts[1] - parts[0]), (self.texts.codes, self.texts.starts[rows] + parts[2], parts[3] - parts[2])):
                begin, size = begin[some], size[some]
                part = np.repeat(np.arange(len(size)), size)
                place = np.arange(len(part)) + np.repeat(begin - np.cumsum(size) + size, size)
                counts.append(np.bincount(part * wide + codes[place], minlength=len(size) * wide).reshape(len(size), wide)[:, :-1])
            out[some] = np.minimum(*counts).sum(1)
        return out


def near(asked: pa.Array, held: pa.Array, least: float, words: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each asked text its place, the places of held texts of a similarity of least or more, which share a word with it if words, and the similarities.

    Counts of characters, shared runs and the longest common subsequence bound the similarity, so few pairs are compared; equal texts are once.
    """
    of_a, of_b, n, m = signatures(asked), signatures(held), lengths(asked), lengths(held)
    texts = Characters(held)
    runs = None
    for i, rows in meeting(asked, held, least, words):
        rows = rows[allowed(of_a[i], of_b[rows], n[i] + m[rows], least)]
        if not len(rows):
            continue
        text = asked[i].as_py()
        if len(rows) >= MANY:
            runs = runs or Runs(texts, int(n.max()))
            rows = runs.allowed(text, np.sort(rows), least)
        rows = rows[2 * texts.common(text, rows) >= least * (n[i] + m[rows])]
        found = {t: similarity(text, t) for t in {texts.texts[k] for k in rows}}
        sims = np.array([found[texts.texts[k]] for k in rows], np.float64)
        yield i, rows[sims >= least], sims[sims >= least]
