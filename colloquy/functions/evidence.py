"""Targets that meet the rows of one text: how similar the lines before both are, by whole-array steps.

A block holds rows of several texts and the targets that ask for them; its caller bounds it. Nothing is made per pair but
a few numbers, of which each target keeps its counts and its best rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from colloquy.functions.blocks import Characters, allowed, lengths, signatures
from colloquy.functions.similarity import similarity


def column(table: pa.Table, name: str) -> pa.Array:
    held = table[name].combine_chunks()
    return pa.concat_arrays(held.chunks) if isinstance(held, pa.ChunkedArray) else held


def codes(*arrays: pa.Array) -> tuple[list[np.ndarray], pa.Array]:
    """The number of each value of arrays, -1 for null, and the values."""
    coded = pa.concat_arrays(arrays).dictionary_encode()
    number = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(number, np.cumsum([len(a) for a in arrays])[:-1]), coded.dictionary


def numbers(table: pa.Table, name: str) -> np.ndarray:
    """Numbers or truth values of a column; null is 0."""
    held = column(table, name)
    return pc.fill_null(held, pa.scalar(0).cast(held.type)).to_numpy(zero_copy_only=False)


def by_text(asked: pa.Table, rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text, salt and share (which a block may hold several of) the places of the targets that ask for it, and those of its rows."""
    (a, b), _ = codes(column(asked, "text_norm"), column(rows, "text_norm"))
    of = lambda t, text: np.stack([text, numbers(t, "salt"), numbers(t, "share")], axis=1)
    values, number = np.unique(np.concatenate([of(asked, a), of(rows, b)]), axis=0, return_inverse=True)
    a, b = np.split(number.reshape(-1), [len(a)])
    order_a, order_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    every = np.arange(len(values) + 1)
    at_a, at_b = np.searchsorted(a[order_a], every), np.searchsorted(b[order_b], every)
    for k in np.flatnonzero((np.diff(at_a) > 0) & (np.diff(at_b) > 0)):
        yield order_a[at_a[k] : at_a[k + 1]], order_b[at_b[k] : at_b[k + 1]]


class Said:
    """The different texts of a block's lines, as what a line is compared with."""

    def __init__(self, texts: pa.Array):
        self.texts, self.sizes, self.parts = texts, lengths(texts), None

    def sims(self, code: int, others: np.ndarray, least: float) -> np.ndarray:
        """Similarities of a text with others (places of texts), or 0 where below least."""
        out, n = np.zeros(len(others)), self.sizes[code]
        kept = np.flatnonzero(2 * np.minimum(n, self.sizes[others]) >= least * (n + self.sizes[others]))
        if least and len(kept):
            if self.parts is None:
                self.parts = signatures(self.texts), Characters(self.texts)
            of, characters = self.parts
            kept = kept[allowed(of[code], of[others[kept]], n + self.sizes[others[kept]], least)]
            if len(kept):
                found = characters.common(self.texts[int(code)].as_py(), others[kept])
                kept = kept[2 * found >= least * (n + self.sizes[others[kept]])]
        text = self.texts[int(code)].as_py() if len(kept) else ""
        for k in kept:
            found = similarity(text, self.texts[int(others[k])].as_py())
            out[k] = found if found >= least else 0.0
        return out


class Contexts:
    """The lines before rows, and the last lines (1 and 2) of the context of targets; texts or other marks of them. blank: the mark of a line without words."""

    def __init__(self, asked: pa.Table, rows: pa.Table, blank):
        said, who = column(rows, "said"), column(rows, "who")
        (held, one, two, empty), self.values = codes(said.flatten(), column(asked, "line1"), column(asked, "line2"), pa.array([blank], said.type.value_type))
        (held_by, by1, by2, self.speaker, self.asked_by, self.only), _ = codes(who.flatten(), column(asked, "by1"), column(asked, "by2"), column(rows, "speaker"), column(asked, "speaker"), column(asked, "by"))
        self.lines, self.blank = {1: (one, by1), 2: (two, by2)}, empty[0]
        size = pc.list_value_length(said).to_numpy(zero_copy_only=False).astype(np.int64)
        place = np.arange(max(1, int(size.max(initial=0))))
        at = np.minimum((np.cumsum(size) - size)[:, None] + place, max(0, len(held) - 1))
        self.there = place < size[:, None]
        self.place = place
        self.said = np.where(self.there, held[at] if len(held) else -1, -1)
        self.who = np.where(self.there, held_by[at] if len(held) else -1, -2)
        self.restricted = numbers(asked, "restricted")

    def rows_of(self, i: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of rows that target i may have, and whether their speaker is the target's."""
        if self.restricted[i]:
            rows = rows[self.speaker[rows] == self.only[i]]
        return rows, (self.speaker[rows] == self.asked_by[i]) & (self.asked_by[i] >= 0)

    def fitting(self, i: int, line: int, rows: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Rows x places: the lines that line of target i may match (its speaker's, if known, and ahead of before)."""
        by = self.lines[line][1][i]
        fits = self.there[rows] if by < 0 else self.who[rows] == by
        return fits if before is None else fits & (self.place < before[:, None])

    def equal(self, i: int, line: int, rows: np.ndarray, fits: np.ndarray) -> np.ndarray:
        """The place of the last fitting line that is equal to line of target i; -1 without one."""
        code = self.lines[line][0][i]
        return np.full(len(rows), -1) if code == self.blank else self.last(fits & (self.said[rows] == code))

    def last(self, which: np.ndarray) -> np.ndarray:
        width = which.shape[1]
        return np.where(which.any(1), width - 1 - which[:, ::-1].argmax(1), -1)

    def sure(self, i: int, rows: np.ndarray, n: int) -> bool:
        """Whether all lines of target i's context have equal ones before one of rows."""
        if n < 1:
            return False
        first = self.equal(i, 1, rows, self.fitting(i, 1, rows))
        rows, first = rows[first >= 0], first[first >= 0]
        return bool(len(rows)) and (n < 2 or bool((self.equal(i, 2, rows, self.fitting(i, 2, rows, first)) >= 0).any()))

    def best(self, i: int, line: int, rows: np.ndarray, least: np.ndarray, texts: Said, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Per row the best similarity of a fitting line to line of target i and its place, -1 without one; ties go to the latest.

        Similarities below least need not be known, they may count as 0. An equal line is the best there can be, so
        others are compared where there is none and less than 1 is asked for.
        """
        code = self.lines[line][0][i]
        fits = self.fitting(i, line, rows, before)
        if code == self.blank:  # it is like no line, so all tie
            return np.zeros(len(rows)), self.last(fits)
        at = self.equal(i, line, rows, fits)
        sim = (at >= 0).astype(np.float64)
        rest = np.flatnonzero((at < 0) & (least < 1) & fits.any(1))
        if len(rest):
            said, fits = self.said[rows[rest]], fits[rest]
            asked = np.zeros(len(self.values), bool)
            asked[said[fits]] = True
            others, sims = np.flatnonzero(asked), np.zeros(len(self.values))
            sims[others] = texts.sims(int(code), others, float(least[rest].min()))
            found = np.where(fits, sims[said], -1.0)
            sim[rest] = found.max(1)
            at[rest] = self.last(found == sim[rest][:, None])
        return sim, at


class Kept:
    """What targets keep of their pairs: counts, the best row, the best of high evidence and the best exact one of it."""

    KINDS, FIELDS = ("best", "best_high", "best_exact"), ("evidence", "target_sim", "context1", "context2", "utterance_id", "exact", "speaker_match")

    def __init__(self, rows: pa.Table):
        self.ids = column(rows, "utterance_id")
        text = pa.types.is_string(self.ids.type) or pa.types.is_large_string(self.ids.type)
        order = pc.array_sort_indices(self.ids.cast(pa.binary()) if text else self.ids).to_numpy()
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.target, self.counts, self.best = [], [], {k: [] for k in self.KINDS}

    def add(self, i: int, counts: tuple[int, int, int], **best: tuple | None) -> None:
        """counts: of pairs, those of high evidence and the exact ones of these. best: per kind the values of FIELDS, with the row's place for its id, or None."""
        self.target.append(i)
        self.counts.append(counts)
        for kind in self.KINDS:
            self.best[kind].append(best[kind])

    def pairs(self, i: int, rows: np.ndarray, match: np.ndarray, evidence: np.ndarray, sim: float, context1: np.ndarray, context2: np.ndarray, exact: bool, high: np.ndarray) -> None:
        """Pairs of target i with rows."""

        def best(some: np.ndarray) -> tuple | None:
            for by in (evidence, context1, context2, self.rank[rows]):
                some = some[by[some] == by[some].max()] if len(some) > 1 else some
            return (evidence[some[0]], sim, context1[some[0]], context2[some[0]], int(rows[some[0]]), exact, bool(match[some[0]])) if len(some) else None

        top, found = best(np.flatnonzero(high)), int(high.sum())
        self.add(i, (len(rows), found, found if exact else 0), best=best(np.arange(len(rows))), best_high=top, best_exact=top if exact else None)

    def batch(self, asked: pa.Table) -> pa.RecordBatch:
        data = {"target_id": column(asked, "target_id").take(pa.array(self.target, pa.int64()))}
        data |= {n: pa.array([c[k] for c in self.counts], pa.int64()) for k, n in enumerate(("num_candidates", "num_high", "num_exact"))}
        for kind, rows in self.best.items():
            for k, field in enumerate(self.FIELDS):
                cells = [None if r is None else r[k] for r in rows]
                data[f"{kind}_{field}"] = self.ids.take(pa.array(cells, pa.int64())) if field == "utterance_id" else pa.array(cells, pa.bool_() if field in ("exact", "speaker_match") else pa.float64())
        return pa.RecordBatch.from_pydict(data)
