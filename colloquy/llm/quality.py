"""Quality classifier: random-indexing word vectors, pooled per document, and a small calibrated network.

Random indexing: every word and every word shape (its classes of characters, runs collapsed) has a fixed sparse random
index vector, made from its hash. A unit's vector is the sum of the index vectors of its neighbours over the whole
corpus, less what neighbours add on average. Units share VECTORS hashed places, so a task holds one array of fixed
size; the tasks' arrays are merged in rounds of a bounded number at a time.

A document's features are the mean and the deviation of its words' vectors and the logarithm of its length. A network
with one hidden layer is trained in numpy on at most TRAIN_ROWS labelled documents (the bound on what the driver
holds), a fifth of which set the temperature that divides its logits. Only texts are inputs of a score.

Defined cases: null and empty texts have all-zero features and the score that the network gives these. Labels other
than 0 and 1 and null labels or ids are not learned from. Without labels of both kinds, every score is the share of
label 1 (0.5 without any). Rows that repeat are scored alike; of rows that share an id, one text
is learned from. An empty table gives an empty result. Extra columns are
ignored by ``report`` and kept by ``scored`` and ``accepted``, whatever their names; ``scored`` raises an error if there
is a ``score`` or ``predicted`` already.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm import words
from colloquy.llm.common import materialise

#: Hashed places for word and shape vectors, and their dimensions.
VECTORS, DIMS = 1 << 14, 64
TRAIN_ROWS = 20_000
HIDDEN = 32
EPOCHS = 30
CUT = 0.3
#: Arrays that one task merges, and places that one row holds.
FAN_IN, PLACES = 64, 256

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48


def shapes(c: words.Chunk) -> np.ndarray:
    """Hashes of the shapes of a chunk's words: classes of characters without repeats in a row."""
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


def units(c: words.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and of the shapes of a chunk."""
    return c.hashes, words.mixed(shapes(c) + np.uint64(0x5851F42D4C957F2D))


def _context_sums(batches):
    """The sums of neighbours' index vectors, as VECTORS x (DIMS + 1) floats; the last column counts neighbours."""
    total = np.zeros((VECTORS, DIMS + 1), np.float32)
    for batch in batches:
        for c in words.chunks(batch.column("text"), size=1 << 18):
            both = units(c)
            rows = c.rows
            for x in range(0, max(len(rows) - 1, 0), 1 << 16):
                y = min(len(rows) - 1, x + (1 << 16))
                near = np.flatnonzero(rows[x:y] == rows[x + 1 : y + 1]) + x
                for a, b in ((near, near + 1), (near + 1, near)):
                    places, signs = [], []
                    for target in both:
                        place = (target[a] % np.uint64(VECTORS)).astype(np.int64) * (DIMS + 1)
                        places.append(place + DIMS)
                        signs.append(np.ones(len(place), np.float32))
                        for context in both:
                            h = context[b]
                            for shift in (20, 40):
                                places.append(place + ((h >> np.uint64(shift)) % np.uint64(DIMS)).astype(np.int64))
                                signs.append(((h >> np.uint64(shift + 10)) & np.uint64(1)).astype(np.float32) * 2 - 1)
                    total += np.bincount(np.concatenate(places), np.concatenate(signs), total.size).reshape(total.shape).astype(np.float32)
    return total


def word_vectors(docs: DataFrame) -> np.ndarray:
    """VECTORS x DIMS floats from all texts of docs."""

    def sums(batches):
        from pyspark import TaskContext

        total = _context_sums(batches)
        blocks = [k for k in range(0, VECTORS, PLACES) if total[k : k + PLACES].any()]
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"part": [part] * len(blocks), "block": blocks, "sums": [total[k : k + PLACES].tobytes() for k in blocks]}, pa.schema([("part", pa.int32()), ("block", pa.int32()), ("sums", pa.binary())]))

    def merge(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.float32) for x in table.column("sums"))
        return pa.table({"part": table.column("group").slice(0, 1), "block": table.column("block").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "part int, block int, sums binary"
    held = materialise(docs.select("text").mapInArrow(sums, schema), "context-sums")
    parts = (held.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        held = held.select(F.floor(F.col("part") / FAN_IN).cast("int").alias("group"), "block", "sums").groupBy("group", "block").applyInArrow(merge, schema)
        parts = -(-parts // FAN_IN)
    total = np.zeros((VECTORS, DIMS + 1), np.float32)
    for row in held.collect():  # VECTORS / PLACES rows, 4 MB together
        total[row["block"] : row["block"] + PLACES] = np.frombuffer(row["sums"], np.float32).reshape(PLACES, DIMS + 1)
    n = total[:, DIMS:]
    mean = total[:, :DIMS].sum(0) / max(n.sum(), 1)
    vectors = total[:, :DIMS] / np.maximum(n, 1) - mean * (n > 0)
    return (vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-3) * (n / (n + 5))).astype(np.float32)


def features(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Features (rows x (2 * DIMS + 1)) of a string column."""
    out = np.zeros((len(column), 2 * DIMS + 1), np.float32)
    for c in words.chunks(column, size=1 << 18):
        both = units(c)
        n = np.diff(c.bounds)
        some = np.flatnonzero(n)
        total = np.zeros((len(n), DIMS), np.float64)
        square = np.zeros((len(n), DIMS), np.float64)
        rows = c.rows
        for x in range(0, len(rows), 1 << 15):
            y = min(len(rows), x + (1 << 15))
            v = vectors[(both[0][x:y] % np.uint64(VECTORS)).astype(np.int64)] + vectors[(both[1][x:y] % np.uint64(VECTORS)).astype(np.int64)]
            first = np.concatenate([[0], np.flatnonzero(np.diff(rows[x:y])) + 1])
            total[rows[x:y][first]] += np.add.reduceat(v, first)
            square[rows[x:y][first]] += np.add.reduceat(v * v, first)
        mean = total[some] / n[some, None]
        at = c.first + some
        out[at, :DIMS] = mean
        out[at, DIMS : 2 * DIMS] = np.sqrt(np.maximum(square[some] / n[some, None] - mean * mean, 0))
        out[at, 2 * DIMS] = np.log1p(n[some])
    return out


class Network:
    """Two layers of weights; logits are divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 3):
        share = float(y.mean()) if len(y) else 0.5
        self.constant = None if len(y) and 0 < share < 1 else share
        if self.constant is not None:
            return
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        x = (x - self.mean) / self.scale
        order = rng.permutation(len(x))
        tune, fit = order[: len(x) // 5], order[len(x) // 5 :]
        w = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), np.array(np.log(share / (1 - share)))]
        m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        for _ in range(EPOCHS):
            for at in np.array_split(rng.permutation(fit), max(1, len(fit) // 256)):
                h = np.maximum(x[at] @ w[0] + w[1], 0)
                p = 1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30)))
                d = (p - y[at]) / len(at)
                dh = np.outer(d, w[2]) * (h > 0)
                grads = [x[at].T @ dh + 1e-4 * w[0], dh.sum(0), h.T @ d + 1e-4 * w[2], d.sum()]
                step += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    w[k] = w[k] - 2e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.weights, self.temperature = w, 1.0
        if len(tune):
            z = self.logits((x[tune] * self.scale) + self.mean)
            losses = {t: np.mean(np.logaddexp(0, z / t) - y[tune] * z / t) for t in np.geomspace(0.25, 8, 41)}
            self.temperature = float(min(losses, key=losses.get))

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.maximum((x - self.mean) / self.scale @ a + b, 0) @ c + d

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, Network]:
    """(word vectors of all docs, network learned from labelled docs that are not held out)."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    vectors = word_vectors(docs)
    known = labels.select("doc_id", F.col("quality").cast("int").alias("y")).filter(F.col("y").isin(0, 1) & ~held_out()).distinct()
    # a label and an id count once, however many rows hold them; hashes are even, so only the lowest are put in order
    place = F.pmod(F.xxhash64("doc_id", "y"), F.lit(1 << 30))
    share = min(1.0, (rows + rows // 4) / max(1, known.count()))
    sample = known.filter(place / (1 << 30) <= share).orderBy(place, "doc_id", "y").limit(rows + rows // 4)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        for batch in batches:
            x = features(batch.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "y", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    met = docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # of rows that share an id, one text
    found = met.mapInArrow(run, f"doc_id {kind}, y int, x binary").toPandas()
    found = found.sort_values(["doc_id", "y"])
    x = np.stack([np.frombuffer(b, np.float32) for b in found["x"]]) if len(found) else np.zeros((0, 2 * DIMS + 1), np.float32)
    return vectors, Network(x.astype(np.float64), found["y"].to_numpy(np.float64))


def _scored(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """docs with columns c0, c1, … instead of their names, and score."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows))
    names, text_at = [f"c{i}" for i in range(len(docs.columns))], docs.columns.index("text")

    def run(batches):
        vectors, network = model.value
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                text = pc.fill_null(part.column(text_at), "")
                score = pa.array(network.scores(features(text, vectors)))
                yield pa.RecordBatch.from_arrays([*part.columns, score], [*names, "score"])

    named = docs.toDF(*names)
    return named.mapInArrow(run, T.StructType([*named.schema.fields, T.StructField("score", T.DoubleType())]))


def scored(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """docs with score and predicted; all columns of docs stay."""
    if taken := {"score", "predicted"} & set(docs.columns):
        raise ValueError(f"there are columns {sorted(taken)} already")
    return _scored(docs, labels, rows).toDF(*docs.columns, "score").withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def report(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    return scored(docs.select("doc_id", "text"), labels, rows).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """docs that are predicted to be of quality 1."""
    return _scored(docs, labels, rows).filter(F.col("score") >= CUT).drop("score").toDF(*docs.columns)
