"""Compression of vectors to codes: product quantisation in integers, with exact matrix products in floating point.

A vector's components become integers floor(scale * x). Vectors are cut into equal parts; each part position has a
codebook of at most ENTRIES entries, which starts as the parts of the vectors with the smallest ids. In each round
every part goes to its nearest entry and entries become the floored means of their parts; then codes are given.

Distances are exact. Integers are broken into limbs of so few bits that every sum of products of two limbs stays below
2^53, so a float64 matrix product of limbs has no rounding whatever the order of its sums; the products are put
together in int64. Of equal distances, the first entry wins.

A round reads the vectors once. Its tasks give sums and counts per codebook entry, which Spark adds up: PARTS x ENTRIES
entries, so the driver holds a table of fixed size.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped. All other vectors need
one length that PARTS divides, and components so small that all distances fit 64 bits (``most_allowed``: 2^27 / scale
for 64 components); else an error is raised. Rows that repeat count row by row; of rows that share an id, the one with the smaller vector comes
first. Rows with a null id come last. With fewer vectors than ENTRIES, codebooks are shorter. Null labels are one
label. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import discard, materialise, salted_join

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors whose distances are held at once.
SLICE = 1024


def most_allowed(width: int) -> int:
    """Bound of an integer component's size such that the squared distances of vectors of width components stay below 2^62."""
    return math.isqrt((1 << 60) // max(width, 1))


def limb_bits(width: int) -> int:
    """Bits of a limb such that width products of two limbs sum to less than 2^53."""
    return (53 - int(np.ceil(np.log2(max(width, 1) + 1)))) // 2


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Integers as float64 limbs, the lowest first: sum of limb[k] << (k * bits). All are below 2^bits in size; the last has the sign."""
    out = []
    while True:
        small = (x < 1 << bits) & (x >= -(1 << bits))
        if small.all():
            return [*out, x.astype(np.float64)]
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits


def exact_dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The products of all rows of x and y (int64), exact."""
    bits = limb_bits(x.shape[-1])
    out = np.zeros((len(x), len(y)), np.int64)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(limbs(y, bits)):
            out += (a @ b.T).astype(np.int64) << np.int64((i + j) * bits)
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance to it) of each row of x. Ties: the first entry."""
    at, far = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    own = (book * book).sum(1)
    for a in range(0, len(x), SLICE):
        some = x[a : a + SLICE]
        d = own[None, :] - 2 * exact_dots(some, book)
        at[a : a + SLICE] = d.argmin(1)
        far[a : a + SLICE] = d[np.arange(len(some)), at[a : a + SLICE]] + (some * some).sum(1)
    return at, far


def integers(column: pa.Array, scale: int = SCALE, parts: int = PARTS, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places of the vectors that are kept, their integer components). width: the length that vectors need to have."""
    column = pc.cast(column, pa.list_(pa.float64()))
    offsets = column.offsets.to_numpy()
    values = column.values
    x = values.to_numpy(zero_copy_only=False)  # nulls become nan
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    kept = np.flatnonzero(valid & (bad[offsets[1:]] == bad[offsets[:-1]]))
    size = np.diff(offsets)[kept]
    if not len(kept):
        return kept, np.zeros((0, width or 0), np.int64)
    width = int(size[0]) if width is None else width
    if (size != width).any() or width % parts or not width:
        raise ValueError(f"vectors need one length that {parts} divides: {sorted(set(size.tolist()) | {width})[:5]}")
    x = np.floor(x[offsets[:-1][kept][:, None] + np.arange(width)] * scale)
    if np.abs(x).max(initial=0) >= most_allowed(width):
        raise ValueError(f"a component's size is {most_allowed(width)} / {scale} or more")
    return kept, x.astype(np.int64)


def first_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE) -> np.ndarray:
    """(parts, entries, width of a part): parts of the vectors with the smallest ids; a top-k of ``entries`` rows."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.filter(F.col("v").isNotNull() & ~bad)
    rows = kept.orderBy(F.asc_nulls_last("vec_id"), F.transform("v", lambda x: F.floor(x * scale))).limit(entries).select("v").toArrow()
    _, x = integers(rows.column("v").combine_chunks(), scale, parts)
    return x.reshape(len(x), parts, x.shape[1] // parts).transpose(1, 0, 2).copy()


def _round(vectors: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    """Codebooks after one round: floored means of the parts that are nearest to each entry; unused entries stay."""
    parts, entries, width = books.shape
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def sums(batches):
        books = shared.value
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            _, x = integers(batch.column("v"), scale, parts, parts * width)
            for p in range(parts):
                mine = x[:, p * width : (p + 1) * width]
                at, _ = nearest(mine, books[p])
                np.add.at(total[p], at, np.concatenate([mine, np.ones((len(mine), 1), np.int64)], 1))
        flat = total.reshape(-1)
        some = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(flat[some])], ["place", "n"])

    met = vectors.select("v").mapInArrow(sums, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()  # parts * entries * (width + 1) rows at most
    total = np.zeros(parts * entries * (width + 1), np.int64)
    total[met["place"].to_numpy(np.int64)] = met["n"].to_numpy(np.int64)
    total = total.reshape(parts, entries, width + 1)
    n = total[:, :, width:]
    return np.where(n > 0, total[:, :, :width] // np.maximum(n, 1), books)


def codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray:
    """(parts, entries, width) integers, fitted to all vectors. vectors: vec_id, v."""
    books = first_codebooks(vectors, parts, entries, scale)
    for _ in range(rounds if books.size else 0):
        books = _round(vectors, books, scale)
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' integers by part, entry and place, joined with commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def coded(vectors: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code (entry of each part, two hexadecimal digits), error (squared distances summed over parts)."""
    parts, _, width = books.shape
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    rest = [c for c in vectors.columns if c != "v"]

    def run(batches):
        books = shared.value
        for batch in batches:
            kept, x = integers(batch.column("v"), scale, parts, parts * width)
            at, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                at[:, p], far = nearest(x[:, p * width : (p + 1) * width], books[p])
                error += far
            code = at.tobytes().hex()
            code = [code[2 * parts * i : 2 * parts * (i + 1)] for i in range(len(x))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(kept)) for c in rest), pa.array(code, pa.string()), pa.array(error)], [*rest, "code", "error"])

    kinds = "".join(f"{c} {vectors.schema[c].dataType.simpleString()}, " for c in rest)
    return vectors.mapInArrow(run, f"{kinds}code string, error long")


def report(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error (errors summed over equal labels), codebooks_sha256."""
    vectors = table.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    books = codebooks(vectors)
    if not books.size:
        none = vectors.filter("false")
        return none.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    codes = coded(vectors, books)
    kind = vectors.schema["label"].dataType
    blank = F.lit("") if kind.typeName() == "string" else F.lit(0)  # null labels are a key of their own
    codes = materialise(codes.withColumns({"unknown": F.col("label").isNull(), "label": F.coalesce("label", blank.cast(kind))}), "codes")
    sums = codes.groupBy("label", "unknown").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("__n"))
    out = salted_join(codes, sums, ["label", "unknown"], ["vec_id", "code"])
    out = materialise(out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")), "vector-codes")
    discard(codes)
    return out
