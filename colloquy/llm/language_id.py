"""Language identification of words and documents with a linear-chain conditional random field.

Features of a word: its prefixes and suffixes of one to three bytes, its two- and three-byte n-grams, the word itself,
and the lexicons (one per language) that list it. Transitions between the languages of neighbouring words are learned
with the feature weights, so that a text may switch its language. Words are labelled by forward-backward; a document
gets the language with the largest expected number of words, and its share as the score.

Training: at most TRAIN_ROWS labelled documents (the bound on what the driver holds), the same number of each language,
or all of a rarer one; with more languages than that, one document of each. A first pass estimates weights
from counts, each word taking its document's language. A line of which another language explains the words better
takes that one; the field is then trained on the labels of lines by gradient ascent on its likelihood.

Forward-backward runs over blocks of words in parallel: products of transition matrices within blocks, a scan over
the blocks of each text, then the blocks again from their true starting points. Its results are those of the plain
recursion, for texts of any length.

Defined cases: a null text or one without a letter gives ``und`` with score 0. Letters are Unicode letters. Documents
with a null language are not learned from. If nothing can be learned, all texts are ``und``. Rows that repeat are
labelled alike, and once in the sample. Of languages that tie, the first in the order of their names is predicted. An
empty table gives an empty result. Only the text is an input of a prediction. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm import words

TRAIN_ROWS = 1_500
#: Hashed places of feature weights.
PLACES = 1 << 18
LEXICON_WORDS = 5_000
STEPS = 12
#: Words of a block of the forward-backward scan.
BLOCK = 64

_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def type_features(c: words.Chunk, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature places, bounds) of the words with the given numbers in a chunk. Words longer than a piece have the word feature only."""
    starts, ends = c.starts[at], c.ends[at]
    n = ends - starts
    parts, owners = [c.hashes[at]], [np.arange(len(at))]
    a = 0
    while a < len(at):  # pieces within which running sums hold; words come in text order
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + words.CHUNK, "right")))
        base, top = starts[a], ends[b - 1]
        if top - base <= words.CHUNK:
            total = words.running(c.data[base:top], words.LOWER)
            s, e, own = starts[a:b] - base, ends[a:b] - base, np.arange(a, b)
            for k in (1, 2, 3):
                parts.append(words.spans(total, s, np.minimum(s + k, e)) + np.uint64(10 + k))
                parts.append(words.spans(total, np.maximum(e - k, s), e) + np.uint64(20 + k))
                owners += [own, own]
            for k in (2, 3):
                many = np.maximum(e - s - k + 1, 0)
                rep = np.repeat(np.arange(len(s)), many)
                from_ = s[rep] + np.arange(len(rep)) - np.repeat(np.cumsum(many) - many, many)
                parts.append(words.spans(total, from_, from_ + k) + np.uint64(30 + k))
                owners.append(own[rep])
        a = b
    places, owners = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    places = (words.mixed(places[order]) % np.uint64(PLACES)).astype(np.int64)
    return places, np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(n)))])


class Field:
    """Languages, feature weights (PLACES x L), lexicons, and transition weights (L x L, log scale)."""

    def __init__(self, langs: list[str]):
        k = len(langs)
        self.langs = langs
        self.weights = np.zeros((PLACES, k), np.float32)
        self.lexicon_hashes, self.lexicon_of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.lexicon_weights = np.zeros((k + 1, k), np.float32)  # the last row: in no lexicon
        self.moves = np.zeros((k, k))

    def lexicon(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.lexicon_hashes):
            return np.full(len(hashes), len(self.langs))
        at = np.minimum(np.searchsorted(self.lexicon_hashes, hashes), len(self.lexicon_hashes) - 1)
        return np.where(self.lexicon_hashes[at] == hashes, self.lexicon_of[at], len(self.langs))

    def type_scores(self, hashes: np.ndarray, places: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        scores = np.add.reduceat(self.weights[places], bounds[:-1]) if len(hashes) else np.zeros((0, len(self.langs)), np.float32)
        return scores / np.sqrt(np.diff(bounds))[:, None] + self.lexicon_weights[self.lexicon(hashes)]

    def word_scores(self, c: words.Chunk) -> np.ndarray:
        """Emission scores of the words of a chunk; features are worked out once per distinct word."""
        _, first, of = np.unique(c.hashes, return_index=True, return_inverse=True)
        order = np.argsort(first)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        at = first[order]
        return self.type_scores(c.hashes[at], *type_features(c, at))[place[of]] if len(at) else np.zeros((0, len(self.langs)), np.float32)


def marginals(scores: np.ndarray, bounds: np.ndarray, moves: np.ndarray, pairs: bool = False):
    """(words x L) probabilities of each word's label; with pairs, also the expected counts of transitions (L x L)."""
    k = moves.shape[0]
    n = np.diff(bounds)
    emit = np.exp(scores - scores.max(1, keepdims=True)) if len(scores) else scores
    step = np.exp(moves - moves.max())
    per = -(-n // BLOCK)  # blocks of each text
    first = np.concatenate([[0], np.cumsum(per)])
    text = np.repeat(np.arange(len(n)), per)
    number = np.arange(first[-1]) - first[text]
    begin = bounds[:-1][text] + number * BLOCK
    size = np.minimum(bounds[1:][text] - begin, BLOCK)
    blocks = len(begin)
    if not blocks:
        return (scores, np.zeros((k, k))) if pairs else scores
    padded = np.ones((BLOCK, blocks, k))
    real = np.arange(BLOCK)[:, None] < size[None, :]
    at = np.minimum(begin[None, :] + np.arange(BLOCK)[:, None], len(scores) - 1)
    padded[real] = emit[at[real]]
    # products of a block's steps: row vector of label weights before the block, times the matrix, gives those after it
    product = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for t in range(BLOCK):
        on = real[t]
        if not on.any():
            break
        new = (product[on] @ step) * padded[t, on][:, None, :]
        product[on] = new / new.sum((1, 2), keepdims=True)
    ahead, behind = np.full((blocks, k), 1 / k), np.ones((blocks, k))
    for j in range(1, int(per.max(initial=0))):
        here = first[:-1][per > j] + j
        v = np.einsum("bi,bij->bj", ahead[here - 1], product[here - 1])
        ahead[here] = v / v.sum(1, keepdims=True)
    for j in range(int(per.max(initial=0)) - 2, -1, -1):
        here = first[:-1][per > j + 1] + j
        v = np.einsum("bij,bj->bi", product[here + 1], behind[here + 1])
        behind[here] = v / v.sum(1, keepdims=True)
    alpha = np.empty((BLOCK, blocks, k))
    a = ahead
    for t in range(BLOCK):
        new = (a @ step) * padded[t]
        new /= new.sum(1, keepdims=True)
        a = np.where(real[t][:, None], new, a)
        alpha[t] = a
    out = np.empty((len(scores), k))
    counts = np.zeros((k, k))
    beta = behind
    for t in range(BLOCK - 1, -1, -1):
        on = real[t]
        if on.any():
            p = alpha[t, on] * beta[on]
            out[at[t, on]] = p / p.sum(1, keepdims=True)
            after = padded[t, on] * beta[on]
            if pairs:
                before = alpha[t - 1, on] if t else ahead[on]
                inner = (t > 0) | (number[on] > 0)
                joint = before[:, :, None] * step[None] * after[:, None, :]
                joint /= joint.sum((1, 2), keepdims=True)
                counts += joint[np.broadcast_to(inner, len(joint))].sum(0)
            v = after @ step.T
            beta = beta.copy()
            beta[on] = v / v.sum(1, keepdims=True)
    return (out, counts) if pairs else out


def learn(texts: list[str], langs_of: list[str]) -> Field:
    """A field from whole texts and their languages."""
    langs = sorted(set(langs_of))
    field, k = Field(langs), len(langs)
    if not langs:
        return field
    number = {x: i for i, x in enumerate(langs)}
    found = list(words.chunks(pa.array(texts), words.LETTERS))
    hashes = np.concatenate([c.hashes for c in found])
    if not len(hashes):
        return field
    bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(c.bounds) for c in found]))])
    label = np.repeat([number[x] for x in langs_of], np.diff(bounds))
    line_ends = []  # words after which a line ends
    for c in found:
        ends = np.cumsum(np.concatenate([[0], c.data == 10]))
        gap = ends[np.append(c.starts[1:], len(c.data))] > ends[c.ends] if len(c.starts) else np.zeros(0, bool)
        line_ends.append(gap)
    line = np.concatenate([[0], np.cumsum(np.concatenate(line_ends))[:-1]]) + np.repeat(np.arange(len(texts)), np.diff(bounds)) * (1 << 32)
    line = np.unique(line, return_inverse=True)[1]
    # features once per distinct word
    types, of = np.unique(hashes, return_inverse=True)
    places, starts, seen, order = [], [0], np.zeros(len(types), bool), []
    offset = 0
    for c in found:
        mine = of[offset : offset + len(c.hashes)]
        _, at = np.unique(mine, return_index=True)
        at = np.sort(at[~seen[mine[at]]])
        seen[mine[at]] = True
        if len(at):
            p, b = type_features(c, at)
            places.append(p)
            starts += (b[1:] + starts[-1]).tolist()
            order.append(mine[at])
        offset += len(c.hashes)
    places, starts, order = np.concatenate(places), np.array(starts), np.concatenate(order)
    slot = np.empty(len(types), np.int64)
    slot[order] = np.arange(len(order))
    of, kinds = slot[of], types[order]
    owner = np.repeat(np.arange(len(kinds)), np.diff(starts))

    def by_feature(type_values: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(places, type_values[owner, y], PLACES) for y in range(k)], 1)

    def by_type(values: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(of, values[:, y], len(kinds)) for y in range(k)], 1)

    def one_hot(y: np.ndarray) -> np.ndarray:
        return np.eye(k)[y]

    def log_ratio(counts: np.ndarray) -> np.ndarray:
        share = (counts + 0.5) / (counts.sum(0) + 0.5)
        return np.log(share) - np.log(share).mean(1, keepdims=True)

    counts = by_type(one_hot(label))
    met = by_feature(counts)
    field.weights = (log_ratio(met) * (met.sum(1, keepdims=True) > 0)).astype(np.float32)
    lines = np.zeros((line.max() + 1, k))
    np.add.at(lines, line, field.type_scores(kinds, places, starts)[of])
    best = lines.argmax(1)
    of_line = np.zeros(len(lines), np.int64)
    of_line[line] = label
    clear = lines[np.arange(len(lines)), best] - lines[np.arange(len(lines)), of_line] > 5
    label = np.where(clear, best, of_line)[line]

    counts = by_type(one_hot(label))
    ratio = log_ratio(counts)
    listed = [(kinds[i], y) for y in range(k) for i in np.argsort(-(ratio[:, y] * np.log1p(counts[:, y])))[:LEXICON_WORDS] if counts[i, y] >= 3 and ratio[i].argmax() == y]
    listed.sort()
    field.lexicon_hashes = np.array([h for h, _ in listed], np.uint64)
    field.lexicon_of = np.array([y for _, y in listed], np.int64)

    target = by_type(one_hot(label))
    same = np.ones(len(label), bool)
    same[bounds[:-1][bounds[:-1] < len(label)]] = False
    wanted_moves = np.zeros((k, k))
    np.add.at(wanted_moves, (label[:-1][same[1:]], label[1:][same[1:]]), 1)
    lexicon = field.lexicon(kinds)
    norm = 1 / np.sqrt(np.diff(starts))[:, None]
    speed = None
    for _ in range(STEPS):
        scores = field.type_scores(kinds, places, starts)
        p, moves = marginals(scores[of].astype(np.float64), bounds, field.moves, pairs=True)
        gap = target - by_type(p)
        g = [by_feature(gap * norm), np.stack([np.bincount(lexicon, gap[:, y], k + 1) for y in range(k)], 1), wanted_moves - moves]
        g[0] -= 0.1 * field.weights
        g[2] -= 1.0 * field.moves
        speed = [s + x * x for s, x in zip(speed or [1e-8] * 3, g, strict=True)]
        field.weights = (field.weights + 0.2 * g[0] / np.sqrt(speed[0])).astype(np.float32)
        field.lexicon_weights = (field.lexicon_weights + 0.3 * g[1] / np.sqrt(speed[1])).astype(np.float32)
        field.moves = field.moves + 0.5 * g[2] / np.sqrt(speed[2])
    return field


def has_letters(c: words.Chunk, texts: pa.Array) -> np.ndarray:
    """For each text of a chunk, whether it holds a letter."""
    known = np.cumsum(np.concatenate([[0], _ASCII_LETTER[c.data]]))
    out = np.zeros(len(c.bounds) - 1, bool)
    at, _ = words.columns(texts)
    cuts = at[c.first : c.first + len(out) + 1] - at[c.first]
    out = known[cuts[1:]] > known[cuts[:-1]]
    for i in np.flatnonzero(~out & (np.diff(c.bounds) > 0)):
        out[i] = any(ch.isalpha() for ch in texts[c.first + int(i)].as_py())
    return out


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def training_sample(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, text, lang of the labelled documents that are learned from."""
    known = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    known = known.withColumn("place", F.xxhash64("doc_id", "text"))
    counts = known.select("lang", "doc_id", "place").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n"))  # rows that repeat count once, as in the sample
    quota = max(1, rows // max(1, counts.count()))
    # a quota of each language in hash order, the same at each run. Hashes are even, so the first of n lie among the
    # lowest (2 * quota + 50) / n of all; only these are put in order, whatever a language's share of the documents
    lowest = F.broadcast(counts.select("lang", ((2 * quota + 50) / F.col("n")).alias("share")))  # one row a language
    ids = known.select("doc_id", "lang", "place").join(lowest, "lang").filter(F.col("place") / F.lit(2.0**64) + 0.5 <= F.col("share")).drop("share").distinct()
    # hashes may be uneven where a language has few documents: one that would get none keeps its first
    lost = counts.join(ids.select("lang").distinct(), "lang", "left_anti").select("lang")
    one = known.join(F.broadcast(lost), "lang").groupBy("lang").agg(F.min_by(F.struct("doc_id", "place"), F.struct("place", "doc_id")).alias("d")).select("d.doc_id", "lang", "d.place")
    ids = ids.unionByName(one)
    first = ids.withColumn("__rank", F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))).filter(F.col("__rank") <= quota)
    first = first.select("doc_id", "lang", "place")  # rows, or one a language
    sample = known.join(F.broadcast(first), ["doc_id", "lang", "place"], "left_semi").dropDuplicates(["doc_id", "lang", "place"])
    return sample.select("doc_id", "text", "lang")


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Field:
    sample = training_sample(docs, rows).toPandas().sort_values(["doc_id", "lang", "text"])
    return learn(sample["text"].tolist(), sample["lang"].tolist())


def predictions(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, lang_pred, score, n_words, switches (expected number of neighbouring words in different languages' hands: changes of the likeliest label)."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        field = shared.value
        langs = np.array([*field.langs, "und"], object)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            for c in words.chunks(texts, words.LETTERS, size=1 << 18):
                n = len(c.bounds) - 1
                known = has_letters(c, texts)
                best, score, switches = np.full(n, len(field.langs)), np.zeros(n), np.zeros(n, np.int64)
                if field.langs and len(c.hashes):
                    p = marginals(field.word_scores(c).astype(np.float64), c.bounds, field.moves)
                    some = np.flatnonzero(np.diff(c.bounds))
                    total = np.add.reduceat(p, c.bounds[some]) / np.diff(c.bounds)[some, None]
                    best[some], score[some] = total.argmax(1), total.max(1)
                    label, rows = p.argmax(1), c.rows
                    switches = np.bincount(rows[1:][(label[1:] != label[:-1]) & (rows[1:] == rows[:-1])], minlength=n)
                best[~known], score[~known] = len(field.langs), 0
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(c.first, n), pa.array(langs[best].tolist(), pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(np.diff(c.bounds)), pa.array(switches)], ["doc_id", "lang_pred", "score", "n_words", "switches"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, n_words long, switches long")


def report(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, n_words, switches."""
    out = predictions(docs, train(docs, rows))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_words", "switches")
