"""Alignment of two tokenizers' tokens over the same bytes.

A is a byte-level BPE of the tokenizers library, which takes a space and the text; B is a sentencepiece model, which
takes the text and adds that space itself. Where a token ends comes from the libraries' own spans first: character
offsets of A, the spans of the proto that B's library returns. A span that starts where the token before ended and is
as long as the token's bytes is the token's own. Tokens that hold only some bytes of a character, byte-fallback tokens
and the space that B adds have no such span; they end where their decoded bytes end. A text has tokens only if the
decoded bytes of both are those of the space and the text.

Neither tokenizer joins anything across a space that follows a character other than white space, nor across a line end
between two such characters. So a text falls into units there, its tokens are those of its units, and a unit is encoded
once per task (while it is held). This follows from A's pre-tokenizer and from B's pieces, in which a space only stands
in front and which hold no line end; the latter is checked when the model is loaded.

Texts are encoded once: a document's links, as distinct pairs of ids, are written with it. Pairs are counted over all
documents. The most frequent pairs, at most HEAD_PAIRS, go to every task as sorted arrays; what documents hold of all
others is joined. The highest count of each B id is one row per id of a vocabulary.

Defined cases: null and empty texts, and those that A or B do not give back, have no tokens: zeros and an empty string.
Rows that repeat, also of one id, count row by row. An empty table gives an empty result. Long texts are aligned whole.
Columns besides id and text are ignored.
"""

from __future__ import annotations

import gc
import itertools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import materialise, salted_join
from colloquy.llm.token_counts import load, tokenizer_path

HEAD_PAIRS = 1 << 20
#: Units, and bytes of units, that a task holds before it begins anew.
UNITS, UNIT_BYTES = 150_000, 16 << 20
#: Bytes of text that are split at once; a longer text is split alone.
SLICE_BYTES = 1 << 20
#: Levels of counts in a doubling.
LEVELS = 16

_B_BITS = 32
_CUT = re.compile(r"(?<=\S)(?= |\n\S)")


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level tokens are written in: bytes that can be seen stand for themselves, the others follow from U+0100."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


def token_ends(starts: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where tokens end, in bytes: by their span where it is as long as their decoded bytes, else by these bytes, from the last such end on."""
    total = np.cumsum(sizes)
    own = np.flatnonzero(ends - starts == sizes)
    last = np.searchsorted(own, np.arange(len(sizes)), "right") - 1  # the last token so far that has a span of its own
    if not len(own):
        return total
    at = own[np.maximum(last, 0)]
    return np.where(last >= 0, ends[at] + total - total[at], total)


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(links' places in a, links' places in b, links' ends, common ends) of two cuts of the same bytes.

    Between two neighbouring cuts of either kind lies one token of each, and tokens that overlap do so in one such stretch.
    """
    both = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")
    twice = np.zeros(len(both), bool)  # both lists rise, so an end stands twice if it is in both
    twice[1:] = both[1:] == both[:-1]
    cuts = both[~twice]
    return np.searchsorted(a_ends, cuts), np.searchsorted(b_ends, cuts), cuts, both[twice]


@dataclass
class Units:
    """Stretches of text: the text of each one's groups, its numbers of A's tokens, B's tokens, groups and links and 1 if it has tokens; and the links of all, as pairs of ids."""

    texts: list[str]
    sizes: np.ndarray
    keys: np.ndarray

    def spread(self, ok: np.ndarray) -> Units:
        """As many units as ok has values; those that are not ok are without tokens."""
        sizes = np.zeros((len(ok), 5), np.int64)
        sizes[ok] = self.sizes
        mine = iter(self.texts)
        return Units([next(mine) if good else "" for good in ok], sizes, self.keys)


class Pair:
    """The two tokenizers."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = load(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = byte_alphabet()
        tokens = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t in tokens]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
            raise ValueError("a piece has a space behind another character, or a line end: texts can't be cut there")

        # a token's digits and what follows them: within its side of a group, or behind it
        self.words = [str(i) + x for x in ",|" for i in range(len(tokens))] + [str(i) + x for x in ",;" for i in range(len(pieces))]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))

    def units(self, texts: list[str]) -> Units:
        """The given units, in order. Those up to the first that can't be joined are encoded as one text, since units are what texts fall into."""
        n = next((i for i, t in enumerate(texts) if not joined(t)), len(texts))
        done = self._encoded(["".join(texts[:n])], texts[:n]) if n else None
        if n and done is None:
            n = 0
        rest = texts[n:]
        if rest:
            ok = np.array([self._encoded([t], [t]) is not None for t in rest])
            good = [t for t, x in zip(rest, ok) if x]
            more = (self._encoded(good, good) if good else Units([], np.zeros((0, 5), np.int64), np.zeros(0, np.int64))).spread(ok)
            done = more if done is None else Units(done.texts + more.texts, np.concatenate([done.sizes, more.sizes]), np.concatenate([done.keys, more.keys]))
        return done

    def _encoded(self, groups: list[str], texts: list[str]) -> Units | None:
        """Units that are the given texts, laid end to end as groups that are encoded each by itself; None if a group's bytes are not given back.

        A group begins with a space, which B adds itself, or with a line end.
        """
        lined = np.array([g[0] == "\n" for g in groups], np.int64)
        raw = [g.encode("utf-8", "surrogatepass") for g in groups]
        whole = b"".join(raw)
        firsts = self.a.encode_batch(groups, add_special_tokens=False)
        seconds = self.b.encode([g if at else g[1:] for g, at in zip(groups, lined.tolist())], return_type="proto", num_threads=1)  # older versions call it out_type="immutable_proto"
        # a piece begins where the one before ends; the space that B adds in front of a line end is a piece of its own
        seconds = [[(p.id, p.end) for p in s.pieces][at:] for s, at in zip(seconds, lined.tolist())]
        ids = [e.ids for e in firsts]
        a, b = _flat(ids), _flat(itertools.chain.from_iterable(seconds)).reshape(-1, 2)
        b, b_stops = b[:, 0], b[:, 1]
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != whole or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != whole:
            return None
        group = np.cumsum([0, *map(len, raw)])
        a_group, b_group = (np.repeat(np.arange(len(groups)), list(map(len, x))) for x in (ids, seconds))
        # A's spans count characters, B's count bytes but for the space that B adds, which its first piece holds
        spans = _flat(x for e in firsts for x in e.offsets).reshape(-1, 2)
        chars = np.cumsum([0, *map(len, groups)])
        leads = np.frombuffer(whole, np.uint8) & 0xC0 != 0x80  # bytes that a character begins with
        bytes_of = np.append(np.flatnonzero(leads), len(whole))
        a_starts, a_stops = (bytes_of[chars[a_group] + spans[:, k]] for k in (0, 1))
        b_stops = group[b_group] + b_stops + (1 - lined)[b_group]
        b_starts = np.concatenate([[0], b_stops[:-1]])
        front = np.ones(len(b), bool)
        front[1:] = b_group[1:] != b_group[:-1]
        b_starts[front] = group[b_group[front]]
        a_ends, b_ends = token_ends(a_starts, a_stops, self.a_sizes[a]), token_ends(b_starts, b_stops, self.b_sizes[b])
        i, j, cuts, common = overlaps(a_ends, b_ends)
        base = np.cumsum([0, *(len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts)])
        count = lambda ends: np.diff(np.searchsorted(ends, base, "right"))
        n_a, n_b = count(a_ends), count(b_ends)
        # the text of the groups between common ends: A's and then B's tokens of each
        between = np.concatenate([2 * np.searchsorted(common, a_ends), 2 * np.searchsorted(common, b_ends) + 1])
        closes = np.concatenate([ends == np.append(common, -1)[np.searchsorted(common, ends)] for ends in (a_ends, b_ends)])
        word = np.concatenate([a, 2 * len(self.a_bytes) + b]) + closes * np.repeat([len(self.a_bytes), len(self.b_bytes)], [len(a), len(b)])
        written = list(map(self.words.__getitem__, word[np.argsort(between, kind="stable")].tolist()))
        at = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        held = ["".join(written[x:y])[:-1] for x, y in zip(at[:-1], at[1:])]
        return Units(held, np.stack([n_a, n_b, count(common), count(cuts), np.ones(len(texts), np.int64)], 1), a[i].astype(np.int64) << _B_BITS | b[j])


def joined(unit: str) -> bool:
    """Whether a unit may be followed by another one in a text, and B gives it back."""
    return not unit[-1].isspace() and "▁" not in unit


def _flat(parts) -> np.ndarray:
    return np.fromiter(itertools.chain.from_iterable(parts), np.int64)


def units_of(text: str) -> list[str]:
    """The units of a space and a text; one that is white space alone stays with the unit before."""
    out = _CUT.split(" " + text)
    if len(out) > 1 and not out[-1].strip():
        last = out.pop()
        out[-1] += last
    return out


class _Grown:
    """Rows that are added in parts and read as one array."""

    def __init__(self, *shape: int):
        self.held, self.n = np.zeros((1024, *shape), np.int64), 0

    def add(self, rows: np.ndarray):
        if self.n + len(rows) > len(self.held):
            more = np.zeros((max(2 * len(self.held), self.n + len(rows)), *self.held.shape[1:]), np.int64)
            more[: self.n] = self.held[: self.n]
            self.held = more
        self.held[self.n : self.n + len(rows)] = rows
        self.n += len(rows)

    @property
    def rows(self) -> np.ndarray:
        return self.held[: self.n]


class _Held:
    """Units that a task holds: their numbers, and what is known of each."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.clear()

    def clear(self):
        self.number: dict[str, int] = {}
        self.texts: list[str] = []
        self.sizes, self.keys, self.bytes = _Grown(5), _Grown(), 0

    def full(self) -> bool:
        return len(self.texts) > UNITS or self.bytes > UNIT_BYTES

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(unit numbers, bounds): the units of texts, one after the other."""
        units = [units_of(t) if t else [] for t in texts]
        number = self.number
        new = list(dict.fromkeys(u for us in units for u in us if u not in number))
        new.sort(key=joined, reverse=True)
        for x in range(0, len(new), 5000):
            some = new[x : x + 5000]
            u = self.pair.units(some)
            number.update(zip(some, range(len(self.texts), len(self.texts) + len(some))))
            self.texts += u.texts
            self.sizes.add(u.sizes)
            self.keys.add(u.keys)
            self.bytes += sum(map(len, some)) + sum(map(len, u.texts))
        bounds = np.cumsum([0, *map(len, units)])
        return np.fromiter(map(number.__getitem__, itertools.chain.from_iterable(units)), np.int64, bounds[-1]), bounds


def _slices(batches):
    """Parts of the batches with some SLICE_BYTES of text each, whole rows."""
    for batch in batches:
        size = np.cumsum([0, *(n or 0 for n in pc.binary_length(batch.column("text")).to_pylist())])
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(size, size[a] + SLICE_BYTES, "right")) - 1)
            yield batch.slice(a, b - a)
            a = b


def _sums(values: np.ndarray, units: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the units' values over each text."""
    total = np.zeros((len(units) + 1, *values.shape[1:]), np.int64)
    np.cumsum(values[units], axis=0, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _whole(held: _Held, units: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sizes per text, which texts have tokens)."""
    total = _sums(held.sizes.rows, units, bounds)
    ok = (total[:, 4] == np.diff(bounds)) & (np.diff(bounds) > 0)
    return np.where(ok[:, None], total[:, :4], 0), ok


class Head:
    """Counts of the most frequent pairs (of least occurrences or more), and the highest count of each B id."""

    def __init__(self, counts: DataFrame, rows: int = HEAD_PAIRS):
        level = F.floor(F.log2("n") * LEVELS).cast("int")
        met = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).orderBy(F.desc("level")).collect()  # LEVELS a doubling
        self.least, total = 1 << 62, 0
        for m in met:
            total += m["k"]
            if total > rows:
                break
            self.least = m["least"]
        head = counts.filter(F.col("n") >= self.least).toPandas()
        keys = head["a"].to_numpy(np.int64) << _B_BITS | head["b"].to_numpy(np.int64)
        order = np.argsort(keys)
        self.keys, self.n = keys[order], head["n"].to_numpy(np.int64)[order]
        best = counts.groupBy("b").agg(F.max("n").alias("n")).toPandas()  # one row per id of B's vocabulary
        self.best = np.zeros(int(best["b"].max()) + 1 if len(best) else 1, np.int64)
        self.best[best["b"].to_numpy(np.int64)] = best["n"].to_numpy(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Counts of pairs; 0 for those outside."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.n[at], 0)


def _links(held: _Held, units: np.ndarray, rows: np.ndarray, ok: np.ndarray) -> pa.Array:
    """Of each text the pairs of ids that it links, with how often."""
    units, rows = units[ok[rows]], rows[ok[rows]]
    many = held.sizes.rows[:, 3]
    first = np.cumsum(many) - many
    n = many[units]
    at = np.repeat(first[units] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    mine, keys = np.repeat(rows, n), held.keys.rows[at]
    order = np.lexsort((keys, mine))
    mine, keys = mine[order], keys[order]
    new = np.flatnonzero(np.concatenate([[True], (mine[1:] != mine[:-1]) | (keys[1:] != keys[:-1])])) if len(keys) else np.zeros(0, np.int64)
    k = np.diff(np.append(new, len(keys)))
    cuts = np.searchsorted(mine[new], np.arange(len(ok) + 1)).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array((keys[new] >> _B_BITS).astype(np.int32)), pa.array((keys[new] & ((1 << _B_BITS) - 1)).astype(np.int32)), pa.array(k.astype(np.int32))], ["a", "b", "k"])
    return pa.ListArray.from_arrays(pa.array(cuts), pairs)


_LINKS = "array<struct<a: int, b: int, k: int>>"


def alignments(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, groups, links.

    groups: ``a1,a2|b1;a3|b2,b3``, the ids of A and B between common ends, in order. links: pairs of ids (a, b) whose
    tokens overlap in the text, and how often (k).
    """
    a_path, b_path = a_path or tokenizer_path("byte_bpe_50k.json"), b_path or tokenizer_path("piece_bpe_32k.model")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        held = _Held(Pair(a_path, b_path))
        gc.disable()  # a task makes many small objects and no cycles of them
        for part in _slices(batches):
            units, bounds = held.of(part.column("text").to_pylist())
            sizes, ok = _whole(held, units, bounds)
            groups = [";".join(map(held.texts.__getitem__, units[x:y].tolist())) if good else "" for x, y, good in zip(bounds[:-1], bounds[1:], ok)]
            links = _links(held, units, np.repeat(np.arange(len(ok)), np.diff(bounds)), ok)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(sizes[:, k]) for k in range(4)), pa.array(groups, pa.string()), links], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"])
            if held.full():
                held.clear()
        gc.enable()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, links {_LINKS}")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, n: how often tokens of the two ids overlap, over all rows of alignments."""
    return aligned.select(F.explode("links").alias("l")).groupBy("l.a", "l.b").agg(F.sum("l.k").alias("n"))


def counted(aligned: DataFrame, counts: DataFrame, head: Head) -> DataFrame:
    """aligned without links, with n_best (links whose count is their B id's highest) and count_sum (over links). aligned has a number ``row``."""
    shared = aligned.sparkSession.sparkContext.broadcast(head)

    def known(batches):
        """Both figures as far as the head tells them, and the links outside it."""
        head = shared.value
        for batch in batches:
            links = batch.column("links")
            cuts = links.offsets.to_numpy().astype(np.int64)
            pairs = links.values.slice(cuts[0], cuts[-1] - cuts[0])
            cuts = cuts - cuts[0]
            a, b, k = (pairs.field(x).to_numpy() for x in range(3))
            each = np.zeros((len(k) + 1, 3), np.int64)
            for x in range(0, len(k), 1 << 20):
                y = min(len(k), x + (1 << 20))
                n = head.of(a[x:y].astype(np.int64) << _B_BITS | b[x:y])
                each[x + 1 : y + 1] = np.stack([k[x:y] * ((n > 0) & (n == head.best[b[x:y]])), k[x:y] * n, n == 0], 1)
            total = np.cumsum(each, axis=0)
            sums = total[cuts[1:]] - total[cuts[:-1]]
            outside = pairs.filter(pa.array(each[1:, 2] > 0))
            tail = pa.ListArray.from_arrays(pa.array(total[cuts, 2].astype(np.int32)), outside)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sums[:, 0]), pa.array(sums[:, 1]), tail], ["row", "n_best", "count_sum", "tail"])

    met = aligned.select("row", "links").mapInArrow(known, f"row long, n_best long, count_sum long, tail {_LINKS}")
    met = materialise(met, "link-counts")
    best = counts.groupBy("b").agg(F.max("n").alias("most"))  # one row per id of B's vocabulary
    outside = counts.filter(F.col("n") < head.least).join(F.broadcast(best), "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("top"), F.col("n").alias("__n"))
    tail = met.filter(F.size("tail") > 0).select("row", F.explode("tail").alias("t")).select("row", "t.a", "t.b", "t.k")
    more = salted_join(tail, outside, ["a", "b"], ["row"]).groupBy("row").agg(F.sum(F.when(F.col("top"), F.col("k")).otherwise(0)).alias("more_best"), F.sum(F.col("k") * F.col("n")).alias("more_sum"))
    added = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
    sums = met.drop("tail").join(more, "row", "left").select("row", added("n_best", "more_best"), added("count_sum", "more_sum"))
    return aligned.drop("links").join(sums, "row")


def report(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    met = alignments(docs, a_path, b_path, id_col, text_col).withColumn("groups_sha256", digest).drop("groups")
    aligned = materialise(met.withColumn("row", F.monotonically_increasing_id()), "alignments")  # the number is written with the row, so it is the same whenever it is read
    counts = materialise(pair_counts(aligned), "pair-counts")
    out = counted(aligned, counts, Head(counts, head_pairs))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
