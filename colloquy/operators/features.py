"""Text and vector features, fitted on training rows and applied to all."""

from __future__ import annotations

from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from colloquy.functions.text import last_lines, tokens
from colloquy.sources.storage import written


def vocabulary(rows: DataFrame, text: str, most: int = 49_998) -> DataFrame:
    """token, n, id of the most frequent tokens of the last lines; ids from 2 (0 pads, 1 is unknown).

    Counts are summed map-side; ids are given after the top-k, over at most ``most`` rows.
    """
    said = rows.select(F.explode(last_lines(F.col(text))).alias("line")).select(F.explode(tokens(F.col("line"))).alias("token"))
    top = said.groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(most)
    return top.withColumn("id", F.row_number().over(Window.orderBy(F.desc("n"), "token")) + 1)


def encoded(rows: DataFrame, key: str, text: str, vocab: DataFrame, most_lines: int = 6, most_tokens: int = 64) -> DataFrame:
    """key, ids (most_lines x most_tokens), token_mask, line_mask: tokens padded on the right, lines on the left.

    A line without tokens keeps its place, masked.
    """
    lines = rows.select(key, F.posexplode(last_lines(F.col(text), most_lines)).alias("at", "line"))
    words = lines.select(key, "at", F.posexplode_outer(tokens(F.col("line"), most_tokens)).alias("place", "token"))
    known = words.join(vocab.select("token", "id"), "token", "left").withColumn("id", F.when(F.col("token").isNotNull(), F.coalesce("id", F.lit(1))))
    by_line = known.groupBy(key, "at").agg(F.array_sort(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("place", "id")))).alias("t"))
    by_line = by_line.select(key, "at", F.transform("t", lambda x: x["id"]).alias("t"))
    pad = lambda a, n, x: F.concat(a, F.array_repeat(x, n - F.size(a)))
    by_line = by_line.select(key, "at", pad(F.col("t"), most_tokens, F.lit(0)).alias("ids"), pad(F.transform("t", lambda _: F.lit(1)), most_tokens, F.lit(0)).alias("mask"), (F.size("t") > 0).cast("int").alias("used"))
    ordered = by_line.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "ids", "mask", "used"))).alias("l"))
    empty = F.array_repeat(F.lit(0), most_tokens)
    front = most_lines - F.size("l")
    field = lambda f: F.transform("l", lambda x: x[f])
    out = ordered.select(key, F.concat(F.array_repeat(empty, front), field("ids")).alias("ids"), F.concat(F.array_repeat(empty, front), field("mask")).alias("token_mask"), F.concat(F.array_repeat(F.lit(0), front), field("used")).alias("line_mask"))
    blank = rows.select(key).join(out.select(key), key, "left_anti")
    none = F.array_repeat(empty, most_lines)
    return out.unionByName(blank.select(key, none.alias("ids"), none.alias("token_mask"), F.array_repeat(F.lit(0), most_lines).alias("line_mask")))


def scaler(rows: DataFrame, vector: str, tiny: float = 1e-8) -> DataFrame:
    """dim, mean, scale: per dimension the mean and population deviation (1 if tiny) of training vectors."""
    parts = rows.select(F.posexplode(vector).alias("dim", "x")).select("dim", F.col("x").cast("double").alias("x"))
    out = parts.groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("scale"))
    return out.withColumn("scale", F.when(F.col("scale") < tiny, 1.0).otherwise(F.col("scale")))


def scaled(rows: DataFrame, vector: str, fitted: DataFrame) -> DataFrame:
    """rows with the vector standardised. The fitted table has one row per dimension, so it is one small array for all rows."""
    table = fitted.agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "scale"))).alias("__f"))
    return rows.join(F.broadcast(table)).withColumn(vector, F.zip_with(vector, "__f", lambda x, f: (x - f["mean"]) / f["scale"])).drop("__f")


def gram_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")


def _word_grams(word: str, low: int, high: int) -> tuple[str, ...]:
    p = f" {word} "
    return tuple(p[i : i + n] for n in range(low, min(high, max(len(p), low)) + 1) for i in range(max(1, len(p) - n + 1)))


#: Grams of words that come back; long words are not held.
_held_grams, HELD = lru_cache(maxsize=50_000)(_word_grams), 40


def char_grams(words: list[str] | None, low: int = 2, high: int = 4) -> Counter:
    """How often a text has each character n-gram within its words, which are padded by one space; a padded word shorter than n counts once."""
    return Counter(chain.from_iterable((_held_grams if len(w) <= HELD else _word_grams)(w, low, high) for w in words or ()))


#: Texts whose grams a task holds at once, and different grams whose sums it holds before it hands them on.
PIECE, SUMS = 200, 500_000


def _texts(batches):
    """Batches in pieces, with the lists of their last column."""
    for batch in batches:
        for lo in range(0, batch.num_rows, PIECE):
            part = batch.slice(lo, PIECE)
            yield part, part.column(part.num_columns - 1).to_pylist()


def _listed(per_row: list, kind: pa.DataType) -> pa.Array:
    cuts = np.concatenate([[0], np.cumsum([len(x) for x in per_row])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(per_row) if isinstance(per_row[0], np.ndarray) else list(chain.from_iterable(per_row)), kind))


def gram_totals(rows: DataFrame, text: str, low: int, high: int) -> DataFrame:
    """gram, df, total: rows that have it and how often they do. Tasks add up first, so no text's grams become rows."""

    def run(batches):
        df, total = Counter(), Counter()

        def handed():
            return pa.RecordBatch.from_arrays([pa.array(list(df), pa.string()), pa.array(list(df.values()), pa.int64()), pa.array([total[g] for g in df], pa.int64())], ["gram", "df", "total"])

        for _, lists in _texts(batches):
            for words in lists:
                counts = char_grams(words, low, high)
                df.update(counts.keys())
                for g, n in counts.items():
                    total[g] += n
            if len(df) > SUMS:
                yield handed()
                df, total = Counter(), Counter()
        yield handed()

    sums = rows.select(gram_words(F.col(text)).alias("__words")).mapInArrow(run, "gram string, df long, total long")
    return sums.groupBy("gram").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """Rows of (gram, total, …) with the largest totals, ties by the gram, at most ``most`` of them.

    The least total that stays comes from the number of grams of each total; only the grams that have just this total
    are put in order.
    """
    levels = counts.groupBy("total").agg(F.count(F.lit(1)).alias("k"))
    above = F.coalesce(F.sum("k").over(Window.orderBy(F.desc("total")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per total
    edge = levels.withColumn("above", above).filter(F.col("above") + F.col("k") > most).agg(F.max("total").alias("__edge"), F.max_by("above", "total").alias("__above")).first()
    if edge[0] is None:
        return counts
    ties = counts.filter(F.col("total") == edge[0]).orderBy("gram").limit(max(0, most - edge[1]))
    return counts.filter(F.col("total") > edge[0]).unionByName(ties)


#: Grams, of a few characters each, that every task may hold.
SMALL_VOCABULARY = 200_000


def gram_weights(rows: DataFrame, text: str, train: Column, min_df: int, most: int, low: int, high: int) -> DataFrame:
    """gram, idf as a written table: the grams of training rows with the largest total count, ties by the gram, and their smooth idf."""
    known = rows.filter(train)
    fitted = gram_totals(known, text, low, high).filter(F.col("df") >= min_df)
    fitted = most_frequent(written(fitted, "gram-totals"), most)
    n = known.agg(F.count(F.lit(1)).alias("n"))
    return written(fitted.join(F.broadcast(n)).select("gram", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")), "gram-weights")


def _with_weights(rows: DataFrame, text: str, idf: list, low: int, high: int, named: bool) -> DataFrame:
    """rows with grams (or their places in idf, which is in their order) and weights: two arrays, worked out where the text is."""
    shared = rows.sparkSession.sparkContext.broadcast(({r["gram"]: k for k, r in enumerate(idf)}, np.array([r["idf"] for r in idf])))
    kind, size = (pa.string(), StringType()) if named else (pa.int32(), IntegerType())

    def run(batches):
        places, idf = shared.value
        names = list(places) if named else None
        for part, lists in _texts(batches):
            grams, weights = [], []
            for words in lists:
                known = sorted((k, n) for g, n in char_grams(words, low, high).items() if (k := places.get(g)) is not None)
                k, n = np.array(known, np.int64).reshape(-1, 2).T
                w = (1 + np.log(n)) * idf[k]
                grams.append([names[i] for i in k] if named else k)
                weights.append(w / np.sqrt((w * w).sum()) if len(w) else w)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], _listed(grams, kind), _listed(weights, pa.float64())], [*part.schema.names[:-1], "grams", "weights"])

    fields = [*rows.schema, StructField("grams", ArrayType(size)), StructField("weights", ArrayType(DoubleType()))]
    return rows.withColumn("__words", gram_words(F.col(text))).mapInArrow(run, StructType(fields))


def tfidf(rows: DataFrame, key: str, text: str, train: Column, min_df: int = 2, most: int = 50_000, low: int = 2, high: int = 4) -> DataFrame:
    """key, gram, weight: sublinear tf times smooth idf, each row's weights of length 1. Vocabulary and idf are of training rows.

    The vocabulary keeps the grams with the largest total count, ties by the gram. A text's grams are counted and weighed
    in the task that has it, a few texts at a time, so what a task holds doesn't depend on its rows; only sums of grams
    are shuffled. A vocabulary of more than SMALL_VOCABULARY grams meets the counts in a shuffle.
    """
    idf = gram_weights(rows, text, train, min_df, most, low, high)
    said = rows.select(key, text).repartition(key)
    if idf.count() <= SMALL_VOCABULARY:
        done = _with_weights(said, text, idf.orderBy("gram").collect(), low, high, named=True)
        return done.select(key, F.explode(F.arrays_zip("grams", "weights")).alias("g")).select(key, F.col("g.grams").alias("gram"), F.col("g.weights").alias("weight"))

    def run(batches):
        for part, lists in _texts(batches):
            counts = [char_grams(words, low, high) for words in lists]
            yield pa.RecordBatch.from_arrays([part.column(0), _listed([list(c) for c in counts], pa.string()), _listed([list(c.values()) for c in counts], pa.int32())], [key, "gram", "tf"])

    kind = StructType([said.schema[key], StructField("gram", ArrayType(StringType())), StructField("tf", ArrayType(IntegerType()))])
    held = said.select(key, gram_words(F.col(text)).alias("__words")).mapInArrow(run, kind).select(key, F.explode(F.arrays_zip("gram", "tf")).alias("g")).select(key, "g.*")
    raw = held.join(idf, "gram").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "gram", (F.col("w") / norm).alias("weight"))


def _vector(size: int, indices: str, values: str) -> Column:
    return F.struct(F.lit(0).cast("byte").alias("type"), F.lit(max(1, size)).alias("size"), F.col(indices).alias("indices"), F.col(values).alias("values"))


def as_vectors(rows: DataFrame, vector: str) -> DataFrame:
    """rows as a written table whose column of structs is read as the MLlib vectors they are."""
    return written(rows, "sparse-vectors", StructType([StructField(f.name, VectorUDT()) if f.name == vector else f for f in rows.schema]))


def with_tfidf(rows: DataFrame, text: str, train: Column, vector: str, min_df: int = 2, most: int = 50_000, low: int = 2, high: int = 4) -> DataFrame:
    """rows with the weights of ``tfidf`` as a sparse vector (a struct, see ``as_vectors``), whose dimensions are the grams in order. No gram is shuffled and no row lost: without known grams it is empty."""
    if most > SMALL_VOCABULARY:
        raise ValueError("a vector's vocabulary is held by every task")
    idf = gram_weights(rows, text, train, min_df, most, low, high).orderBy("gram").collect()
    return _with_weights(rows, text, idf, low, high, named=False).withColumn(vector, _vector(len(idf), "grams", "weights")).drop("grams", "weights")


def sparse_vectors(weights: DataFrame, key: str) -> DataFrame:
    """key, vector: MLlib vectors of (key, gram, weight) rows. Their dimensions are the grams in order; a vocabulary is bounded, so its numbers are one small table."""
    grams = written(weights.select("gram").distinct(), "grams")
    numbered = grams.withColumn("at", F.row_number().over(Window.orderBy("gram")) - 1)
    per = weights.join(numbered, "gram").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "weight"))).alias("p"))
    per = per.select(key, F.transform("p", lambda x: x["at"]).alias("at"), F.transform("p", lambda x: x["weight"]).alias("weight"))
    return as_vectors(per.select(key, _vector(grams.count(), "at", "weight").alias("vector")), "vector")


def with_hashed_text(rows: DataFrame, tokens_of: Column, dims: int = 64) -> DataFrame:
    """rows with vector: counts of hashed tokens in dims dimensions, of length 1 (zeros without tokens): a vector of fixed size where no encoder's is given."""
    held = rows.withColumn("__w", F.coalesce(tokens_of, F.array().cast("array<string>")))
    counted = HashingTF(inputCol="__w", outputCol="__c", numFeatures=dims).transform(held)
    return Normalizer(inputCol="__c", outputCol="__v").transform(counted).withColumn("vector", vector_to_array("__v")).drop("__w", "__c", "__v")


def hashed_text(rows: DataFrame, key: str, tokens_of: Column, dims: int = 64) -> DataFrame:
    """key, vector of ``with_hashed_text``."""
    return with_hashed_text(rows, tokens_of, dims).select(key, "vector")


def mean_pooled(rows: DataFrame, key: str, vector: str, weight: Column | None = None) -> DataFrame:
    """key, vector: the mean of a segment's vectors, of length 1. A value that is not finite or a zero mean raises an error."""
    parts = rows.select(key, F.posexplode(vector).alias("dim", "x")).groupBy(key, "dim").agg(F.avg("x").alias("x"))
    out = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("v")).withColumn("v", F.transform("v", lambda p: p["x"]))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    bad = F.exists("v", lambda x: F.isnan(x) | (F.abs(x) == float("inf"))) | (norm == 0)
    checked = F.when(bad, F.raise_error(F.lit("a pooled vector is not finite or zero")).cast("double")).otherwise(norm)
    return out.withColumn("__n", checked).select(key, F.transform("v", lambda x: x / F.col("__n")).alias("vector"))
