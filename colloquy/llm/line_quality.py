"""Line sequence labelling: a linear-chain conditional random field marks each line of a text as content or boilerplate.

A line is what stands between line ends; lines without a word have no label. Features of a line are bucketed measures
(words, their length, letters, digits, symbols, repeated words, first and last character, place, a copy of an earlier
line) and the hashed words and word shapes it holds. The label sequence of a text is the likeliest one by Viterbi
decoding; the share of characters in lines of content decides whether the text is retained.

Training: lines have no labels of their own. At most TRAIN_ROWS documents with a quality label, as many of each label,
are the sample (the bound on what the driver holds: texts beyond TRAIN_BYTES are not learned from). Lines first take
their document's label, content for 1 and boilerplate for 0. A line that the other label explains much better takes
that one; the field is then trained on the lines' labels by gradient ascent on its likelihood, with forward-backward.

Besides there are plain rules of the whole text: words, characters in words, symbols, copied lines, and words in
three-word windows that occur twice or more. A text with fewer than 50 words, or more than half of its words in such
windows, fails them and is not retained.

Words, lines and windows are told apart by 64-bit hashes. Words are runs of characters other than U+0020 and U+0009 to
U+000D.

Defined cases: null texts have no words, like empty ones, and fail. Labels other than 0 and 1, null labels and null ids
are not learned from; without labels of both kinds all lines are content. Of rows that repeat an id, one is learned from;
all are judged. An empty table gives an empty result. Only the text decides. Long texts are judged whole. Columns
besides id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm import words
from colloquy.llm.language_id import marginals

TRAIN_ROWS, TRAIN_BYTES = 2_000, 1 << 16
#: Hashed places of the weights of words and shapes.
PLACES = 1 << 15
STEPS = 25
#: Share of the characters in words that has to stand in lines of content.
CONTENT_SHARE = 0.5
LEAST_WORDS = 50
BOILERPLATE, CONTENT = 0, 1

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48
#: Buckets of the measures, in order.
_BUCKETS = (9, 17, 11, 9, 9, 9, 7, 4, 4, 2, 3)


def _counts(mask: np.ndarray, cuts: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
    """How often mask is true in the ranges from cuts to ends (or to the next cut)."""
    total = np.concatenate([[0], np.cumsum(mask)])
    return total[ends] - total[cuts] if ends is not None else np.diff(total[cuts])


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which keys occur twice or more, which have occurred before)."""
    _, first, of, n = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    return n[of] > 1, first[of] != np.arange(len(keys))


class Lines:
    """Lines with a word of the texts of a chunk: bounds (where each text's lines begin), first and last word, bytes, features; and what the plain rules need."""

    def __init__(self, c: words.Chunk, cuts: np.ndarray):
        data, rows, n = c.data, c.rows, len(c.starts)
        self.rules = self._rules(c, cuts)
        new_line = np.concatenate([[0], np.cumsum(data == 10)])[c.starts]
        first = np.ones(n, bool)
        first[1:] = (new_line[1:] != new_line[:-1]) | (rows[1:] != rows[:-1])
        self.first = np.flatnonzero(first)  # word that a line begins with
        self.last = np.append(self.first[1:], n)
        of_text = rows[self.first]
        self.bounds = np.searchsorted(of_text, np.arange(len(c.bounds)))
        line_of = np.cumsum(first) - 1
        # whole lines, from one line end (or the text's first byte) to the next
        ends = np.flatnonzero(data == 10)
        before = np.searchsorted(ends, c.starts[self.first]) if n else np.zeros(0, np.int64)
        self.start = np.maximum(np.append(ends, -1)[before - 1] + 1 if len(ends) else 0, cuts[of_text]) if n else np.zeros(0, np.int64)
        self.start = np.where(before > 0, self.start, cuts[of_text]) if n else self.start
        self.end = np.minimum(np.append(ends, len(data))[before], cuts[of_text + 1]) if n else np.zeros(0, np.int64)
        hashes = words.hash_spans(data, self.start, self.end)
        copied = _repeated(words.mixed(hashes + words.mixed(of_text.astype(np.uint64))))[1] if n else np.zeros(0, bool)
        self.rules["n_dup_lines"] = np.bincount(of_text[copied], minlength=len(c.bounds) - 1)
        inner = data & 0xC0 != 0x80
        self.chars = np.add.reduceat(_counts(inner, c.starts, c.ends), self.first) if n else np.zeros(0, np.int64)
        self.measures = self._measures(c, line_of, copied) if n else np.zeros((0, len(_BUCKETS)), np.int64)
        shapes = self._shapes(c)
        self.places = (np.stack([words.mixed(c.hashes + np.uint64(1)), words.mixed(shapes + np.uint64(2))], 1) % np.uint64(PLACES)).astype(np.int64)
        self.line_of = line_of

    @staticmethod
    def _rules(c: words.Chunk, cuts: np.ndarray) -> dict[str, np.ndarray]:
        texts, rows = len(c.bounds) - 1, c.rows
        size = _counts(c.data & 0xC0 != 0x80, c.starts, c.ends) if len(c.starts) else np.zeros(0, np.int64)
        windows = np.flatnonzero(rows[2:] == rows[:-2]) if len(rows) > 2 else np.zeros(0, np.int64)
        h = c.hashes
        keys = words.mixed(words.mixed(words.mixed(h[windows] + words.mixed(rows[windows].astype(np.uint64))) + h[windows + 1]) + h[windows + 2])
        again = windows[_repeated(keys)[0]] if len(windows) else windows
        covered = np.zeros(len(rows), bool)
        for k in range(3):
            covered[again + k] = True
        return {
            "n_words": np.diff(c.bounds), "word_chars": np.bincount(rows, size, texts).astype(np.int64), "n_symbols": _counts(_SYMBOL[c.data], cuts), "n_repeat_words": np.bincount(rows[covered], minlength=texts),
        }

    @staticmethod
    def _shapes(c: words.Chunk) -> np.ndarray:
        """Hashes of words as classes of characters without repeats in a row."""
        kind = _SHAPE[c.data]
        inside = np.zeros(len(kind) + 1, np.int8)
        np.add.at(inside, c.starts, 1)
        np.add.at(inside, c.ends, -1)
        keep = np.cumsum(inside[:-1]) > 0
        same = np.zeros(len(kind), bool)
        same[1:] = kind[1:] == kind[:-1]
        same[c.starts] = False
        keep &= ~same
        at = np.concatenate([[0], np.cumsum(keep)])
        return words.hash_spans(kind[keep], at[c.starts], at[c.ends])

    def _measures(self, c: words.Chunk, line_of: np.ndarray, copied: np.ndarray) -> np.ndarray:
        n = self.last - self.first
        size = np.add.reduceat(c.ends - c.starts, self.first)
        share = lambda mask: np.add.reduceat(_counts(mask[c.data], c.starts, c.ends), self.first) / size
        repeated = _repeated(words.mixed(c.hashes + words.mixed(line_of.astype(np.uint64))))[1]
        next_same = np.zeros(len(c.hashes), bool)
        next_same[1:] = (c.hashes[1:] == c.hashes[:-1]) & (line_of[1:] == line_of[:-1])
        of_line = lambda mask: np.add.reduceat(mask.astype(np.int64), self.first) / n
        tenth = lambda x, k: np.where(x > 0, np.minimum((x * (k - 1)).astype(np.int64) + 1, k - 1), 0)
        head, tail = c.data[c.starts[self.first]], c.data[c.ends[self.last - 1] - 1]
        kind = lambda b: np.where((b >= 97) & (b < 123), 0, np.where((b >= 65) & (b < 91), 1, np.where(b >= 128, 2, 3)))
        closing = np.where(np.isin(tail, list(b".!?")), 0, np.where(np.isin(tail, list(b",;:")), 1, np.where(words.ALNUM[tail], 2, 3)))
        place = np.ones(len(n), np.int64)
        some = np.flatnonzero(np.diff(self.bounds))
        place[self.bounds[1:][some] - 1] = 2
        place[self.bounds[:-1][some]] = 0
        return np.stack([
            np.minimum(np.log2(n).astype(np.int64), 8), np.minimum(size // n, 16), tenth(share(words.LETTERS), 11), tenth(of_line(repeated), 9), tenth(of_line(next_same), 9), tenth(share(_SYMBOL), 9), tenth(share(_DIGIT), 7),
            kind(head), closing, copied.astype(np.int64), place,
        ], 1)


def lines_of(column: pa.Array, size: int = words.CHUNK):
    """(first row, Lines) of the texts of a string column without nulls, whole texts at a time."""
    at, _ = words.columns(column)
    for c in words.chunks(column, fold=words.SAME, size=size):
        texts = len(c.bounds) - 1
        yield c.first, Lines(c, at[c.first : c.first + texts + 1] - at[c.first])


def viterbi(scores: np.ndarray, bounds: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The likeliest label sequence of each text, from scores of its places and transition weights; of equal ones, the smaller label. All texts take a step at once."""
    n = np.diff(bounds)
    order = np.argsort(-n, kind="stable")
    start, size = bounds[:-1][order], n[order]
    best, back = scores.astype(np.float64), np.zeros(scores.shape, np.int8)
    steps = [start[: np.searchsorted(-size, -t)] + t for t in range(1, int(size.max(initial=0)))]  # texts longer than t
    for at in steps:
        through = best[at - 1][:, :, None] + moves[None]
        back[at] = through.argmax(1)
        best[at] += through.max(1)
    labels = np.zeros(len(scores), np.int64)
    last = bounds[1:][n > 0] - 1
    labels[last] = best[last].argmax(1)
    for at in reversed(steps):
        labels[at - 1] = back[at, labels[at]]
    return labels


class Field:
    """Weights of measures, words and shapes for both labels, and of transitions. Untrained, all lines are content."""

    def __init__(self):
        self.measures = [np.zeros((k, 2)) for k in _BUCKETS]
        self.places = np.zeros((PLACES, 2), np.float32)
        self.moves = np.zeros((2, 2))
        self.bias = np.array([0.0, 1.0])

    def scores(self, lines: Lines) -> np.ndarray:
        if not len(lines.first):
            return np.zeros((0, 2))
        out = self.bias + sum(w[lines.measures[:, k]] for k, w in enumerate(self.measures))
        per_word = self.places[lines.places].sum(1)
        return out + np.add.reduceat(per_word, lines.first) / np.sqrt(lines.last - lines.first)[:, None]

    def labels(self, lines: Lines) -> np.ndarray:
        return viterbi(self.scores(lines), lines.bounds, self.moves)


def learn(texts: list[str], quality: list[int]) -> Field:
    """A field from whole texts and their documents' labels."""
    field = Field()
    if len(set(quality)) < 2:
        return field
    found = [x for _, x in lines_of(pa.array(texts, pa.string()))]
    per_text = np.concatenate([np.diff(x.bounds) for x in found])
    bounds = np.concatenate([[0], np.cumsum(per_text)])
    if not bounds[-1]:
        return field
    document = np.repeat(np.array(quality), per_text)
    measures = np.concatenate([x.measures for x in found])
    places = np.concatenate([x.places for x in found])
    sizes = np.concatenate([x.last - x.first for x in found])
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    line_of = np.repeat(np.arange(len(sizes)), sizes)
    norm = 1 / np.sqrt(sizes)

    def by_feature(values: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Sums of the lines' values (lines x 2) over features."""
        flat = [np.stack([np.bincount(measures[:, k], values[:, y], b) for y in (0, 1)], 1) for k, b in enumerate(_BUCKETS)]
        shared = (values * norm[:, None])[line_of]
        return flat, np.stack([sum(np.bincount(places[:, j], shared[:, y], PLACES) for j in (0, 1)) for y in (0, 1)], 1)

    def scores() -> np.ndarray:
        out = field.bias + sum(w[measures[:, k]] for k, w in enumerate(field.measures))
        return out + np.add.reduceat(field.places[places].sum(1), first) * norm[:, None]

    def log_ratio(counts: np.ndarray) -> np.ndarray:
        share = np.log((counts + 1) / (counts.sum(0) + len(counts)))
        return (share - share.mean(1, keepdims=True)) * (counts.sum(1, keepdims=True) > 0)

    field.bias = np.zeros(2)
    flat, hashed = by_feature(np.eye(2)[document])
    field.measures, field.places = [log_ratio(x) for x in flat], log_ratio(hashed).astype(np.float32)
    s = scores()
    better = s.argmax(1)
    label = np.where(np.abs(s[:, 0] - s[:, 1]) > 5, better, document)
    # from here on the field is fitted to the lines' labels
    field.measures, field.places = [np.zeros((k, 2)) for k in _BUCKETS], np.zeros((PLACES, 2), np.float32)
    wanted, wanted_moves = np.eye(2)[label], np.zeros((2, 2))
    inner = np.ones(len(label), bool)
    inner[bounds[:-1][per_text > 0]] = False
    np.add.at(wanted_moves, (label[:-1][inner[1:]], label[1:][inner[1:]]), 1)
    speed = None
    for _ in range(STEPS):
        p, moves = marginals(scores(), bounds, field.moves, pairs=True)
        flat, hashed = by_feature(wanted - p)
        g = [*(x - 0.1 * w for x, w in zip(flat, field.measures)), hashed - 0.5 * field.places, wanted_moves - moves - field.moves]
        speed = [s + x * x for s, x in zip(speed or [1e-8] * len(g), g)]
        step = [0.3 * x / np.sqrt(s) for x, s in zip(g, speed)]
        field.measures = [w + d for w, d in zip(field.measures, step)]
        field.places = (field.places + step[-2]).astype(np.float32)
        field.moves = field.moves + step[-1]
    return field


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> DataFrame:
    """doc_id, y, text: at most rows documents, as many of each label (or all of the rarer one), one row per id and label."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull()).distinct()
    held = docs.select("doc_id", "text").filter(F.octet_length("text") <= size)
    known = known.join(held.select("doc_id").distinct(), "doc_id", "left_semi")
    place = F.xxhash64("doc_id")
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    quota = rows // 2
    # hashes are even: the first of n lie among the lowest (2 * quota + 50) / n of all, and only these are put in order
    share = F.when(F.col("y") == 1, (2 * quota + 50) / max(1, counts.get(1, 0))).otherwise((2 * quota + 50) / max(1, counts.get(0, 0)))
    low = known.filter(place / F.lit(2.0**64) + 0.5 <= share)
    first = low.withColumn("n", F.row_number().over(Window.partitionBy("y").orderBy(place, "doc_id"))).filter(F.col("n") <= quota).drop("n")
    met = held.join(F.broadcast(first), "doc_id")  # 2 * quota rows
    return met.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Field:
    found = training_sample(docs, labels, rows).toPandas().sort_values(["doc_id", "y"])
    return learn(found["text"].tolist(), found["y"].tolist())


def labelled(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, content_chars (characters of words in lines of content), content (of each line with a word, whether it is content)."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rules = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        field = shared.value
        for batch in batches:
            for first, lines in lines_of(pc.fill_null(batch.column("text"), "")):
                label = field.labels(lines)
                kept = np.concatenate([[0], np.cumsum(np.where(label == CONTENT, lines.chars, 0))])
                held = pa.ListArray.from_arrays(pa.array(lines.bounds.astype(np.int32)), pa.array(label == CONTENT))
                n = len(lines.bounds) - 1
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, n), *(pa.array(lines.rules[r].astype(np.int64)) for r in rules), pa.array(kept[lines.bounds[1:]] - kept[lines.bounds[:-1]]), held], ["doc_id", *rules, "content_chars", "content"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{r} long" for r in rules) + ", content_chars long, content array<boolean>")


def report(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = labelled(docs, train(docs, labels, rows))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~failed & (F.col("content_chars") >= CONTENT_SHARE * F.col("word_chars"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"))
