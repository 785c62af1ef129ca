"""Exact deduplication with a log-structured merge index of text digests.

Write path: every task buffers (digest, id) rows in a bounded memtable. A full memtable is merged and flushed as
a run sorted by digest, together with the run's filter: the sorted hash slots of its digests. Runs and filters are
Parquet files in the shared folder.
Compaction: the filters are probed first; a digest whose slot no other run holds needs no merge and stays in its run.
The others are merged by digest, keeping the smallest (or largest) id and the number of rows.
Read path: digests with more than one row are hits. A filter of the hits picks the candidate rows, whose whole texts
are grouped, so that rows count as equal only if their bytes are equal, also if digests collide.

Defined cases: a null text counts as empty, so null and empty texts form one group. Null ids never win over another
id; a group of null ids keeps a null. Rows that repeat an id and text count in ``group_size`` and are all reported as
kept; ``drop_copies`` leaves one of them. Ids are whole numbers; others raise an error. Empty tables give empty
results. Columns besides id and text are ignored; ``drop_copies`` keeps them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import materialise, new_path, salted_join, whole_ids

#: Rows that a task buffers before it flushes a run.
MEMTABLE_ROWS = 65_536
#: Bits of a filter: 16 a key, within these bounds. The largest is half a million words of 64 bits, however large the corpus is.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 25
#: Hash slots of the runs' filters.
RUN_SLOTS = 1 << 31


def text_digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def flush_runs(rows: DataFrame, memtable_rows: int = MEMTABLE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Flush (digest, id, slot) rows as sorted runs to the shared folder and return (runs, filters).

    runs: run, digest, slot, least_id, most_id, n; a digest occurs at most once a run. filters: run, slots (sorted).
    """

    def run(batches):
        from pyspark import TaskContext

        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            table = pa.Table.from_batches(held).group_by(["digest", "slot"]).aggregate([("id", "min"), ("id", "max"), ("id", "count", pc.CountOptions(mode="all"))])
            table = table.sort_by("digest").combine_chunks()
            name = pa.array(np.full(table.num_rows, (part << 32) + number))
            columns = [table.column(c).combine_chunks() for c in ("digest", "slot", "id_min", "id_max", "id_count")]
            none = pa.nulls(table.num_rows, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([name, *columns, none, pa.array(np.zeros(table.num_rows, np.int32))], schema=schema)
            slots = pa.array([np.unique(table.column("slot").to_numpy())], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([name.slice(0, 1), *(pa.nulls(1, schema.field(c).type) for c in schema.names[1:6]), slots, pa.array([1], pa.int32())], schema=schema)

        for batch in batches:
            for a in range(0, batch.num_rows, memtable_rows):
                piece = batch.slice(a, memtable_rows)
                held.append(piece)
                size += piece.num_rows
                if size >= memtable_rows:
                    yield from flush()
                    number, held, size = number + 1, [], 0
        if held:
            yield from flush()

    schema = pa.schema([("run", pa.int64()), ("digest", pa.string()), ("slot", pa.int64()), ("least_id", pa.int64()), ("most_id", pa.int64()), ("n", pa.int64()), ("slots", pa.list_(pa.int64())), ("is_filter", pa.int32())])
    flushed = rows.select("digest", "slot", "id").mapInArrow(run, "run long, digest string, slot long, least_id long, most_id long, n long, slots array<long>, is_filter int")
    path = new_path(rows.sparkSession, "digest-runs")
    flushed.write.partitionBy("is_filter").parquet(path)
    back = rows.sparkSession.read.schema(flushed.schema).parquet(path)
    return back.filter("is_filter = 0").drop("slots", "is_filter"), back.filter("is_filter = 1").select("run", "slots")


def compact(runs: DataFrame, filters: DataFrame) -> DataFrame:
    """Merge runs into the digests of two rows or more: digest, least_id, most_id, n. Only digests whose slot two runs hold are moved."""
    met = filters.select(F.explode("slots").alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    met = filter_words(materialise(met.select(F.col("slot").cast("string").alias("digest")), "met-slots"))
    named = runs.withColumn("__d", F.col("digest")).withColumn("digest", F.col("slot").cast("string"))
    back = lambda df: df.select(F.col("__d").alias("digest"), "least_id", "most_id", "n")
    merged = back(passes_filter(named, met)).groupBy("digest").agg(F.min("least_id").alias("least_id"), F.max("most_id").alias("most_id"), F.sum("n").alias("n"))
    return merged.unionByName(back(passes_filter(named, met, inverse=True))).filter("n > 1")


@dataclass
class Filter:
    """A one-hash Bloom filter as (word, bits) rows."""

    words: DataFrame
    bits: int


def _slot(digest: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(bits))


def filter_words(digests: DataFrame) -> Filter:
    """A filter of the column digest; its size follows their number, up to MOST_BITS."""
    n = digests.count()
    bits = LEAST_BITS
    while bits < min(16 * n, MOST_BITS):
        bits *= 2
    slot = _slot(F.col("digest"), bits)
    words = digests.select(F.floor(slot / 64).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    return Filter(words, bits)


def passes_filter(rows: DataFrame, filter_: Filter, inverse: bool = False) -> DataFrame:
    """Rows whose digest may be in the filter; inverse: those whose digest is surely not. The words have a fixed bound, so they are broadcast."""
    words = filter_.words.select(F.col("word").alias("__w"), F.col("bits").alias("__bits"))
    slot = _slot(F.col("digest"), filter_.bits)
    hit = rows.withColumn("__word", F.floor(slot / 64)).join(F.broadcast(words), F.col("__word") == F.col("__w"), "left")
    bit = F.call_function("shiftrightunsigned", F.coalesce("__bits", F.lit(0)).cast("long"), (slot % 64).cast("int")).bitwiseAND(F.lit(1).cast("long"))
    return hit.filter(bit == (0 if inverse else 1)).drop("__word", "__w", "__bits")


def equal_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=text_digest, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """Classes of byte-equal texts with two rows or more: digest, text, least_id, most_id, n, n_texts (classes of that digest)."""
    bodies = docs.select(digest(F.col(text_col)).alias("digest"), whole_ids(docs, id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = bodies.select("digest", F.pmod(F.xxhash64("digest"), F.lit(RUN_SLOTS)).alias("slot"), "id")
    level = materialise(compact(*flush_runs(keyed, memtable_rows)), "digest-level")
    # sums on the map side leave one row of each text a task, so a text with many copies moves few times
    hits = passes_filter(bodies, filter_words(level)).groupBy("digest", "text").agg(F.min("id").alias("least_id"), F.max("id").alias("most_id"), F.count(F.lit(1)).alias("n"))
    hits = hits.join(level.select("digest"), "digest", "left_semi")
    hits = materialise(hits, "digest-hits")
    texts = hits.groupBy("digest").agg(F.count(F.lit(1)).alias("n_texts"))
    return hits.join(texts, "digest").filter("n > 1 or n_texts > 1")


def with_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "least", digest=text_digest, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """docs with __digest, __keep_id and __group_size: the id that stays of each row's class of equal texts, and its rows.

    keep: ``least`` or ``most``, the id that stays. Rows of large classes meet them by a salted join.
    """
    classes = equal_texts(docs, id_col, text_col, digest, memtable_rows).select(F.col("digest").alias("__digest"), "text", F.col(f"{keep}_id").alias("__keep"), F.col("n").alias("__size"), F.col("n").alias("__n"), "n_texts")
    classes = materialise(classes, "digest-classes")
    out = salted_join(docs.withColumn("__digest", digest(F.col(text_col))), classes.filter("n_texts = 1").drop("text", "n_texts"), ["__digest"], [id_col], "left")
    collided = classes.filter("n_texts > 1")
    if collided.limit(1).count():  # different texts under one digest: those rows are told apart by their bytes
        more = collided.select(F.col("__digest").alias("__d2"), F.col("text").alias("__t2"), F.col("__keep").alias("__k2"), F.col("__size").alias("__n2"))
        out = out.join(more, (F.col("__digest") == F.col("__d2")) & (F.coalesce(F.col(text_col), F.lit("")) == F.col("__t2")), "left")
        out = out.withColumn("__keep", F.coalesce("__keep", "__k2")).withColumn("__size", F.coalesce("__size", "__n2")).drop("__d2", "__t2", "__k2", "__n2")
    single = F.col("__size").isNull()
    out = out.withColumn("__keep_id", F.when(single, whole_ids(docs, id_col)).otherwise(F.col("__keep"))).withColumn("__group_size", F.coalesce(F.col("__size"), F.lit(1).cast("long")))
    return out.drop("__keep", "__size")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "least", **more) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept and text_sha256."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_digest(F.col(text_col)).alias("text_sha256"))
    out = with_group(narrow, keep=keep, **more)  # without collisions, texts are not needed behind this and not shuffled
    return out.select("doc_id", F.col("__keep_id").alias("keep_id"), F.col("__group_size").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("__keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "least", digest=text_digest, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """docs without the rows whose text another row holds; of each group the row with the least (most) id stays.

    Rows whose digest is in no class stay where they are. For the others, (digest, id) pairs meet the classes first; only
    rows whose pair may stay are moved with their texts, about one a class.
    """
    names = docs.columns
    classes = materialise(equal_texts(docs, id_col, text_col, digest, memtable_rows), "digest-classes")
    rows = docs.withColumn("__digest", digest(F.col(text_col)))
    known = filter_words(classes.select("digest"))
    named = lambda df, key: df.withColumnsRenamed({c: f"__c{i}" for i, c in enumerate(names)}).withColumn("digest", key)
    back = lambda df: df.drop("digest").withColumnsRenamed({f"__c{i}": c for i, c in enumerate(names)})
    id_at, text_at = f"__c{names.index(id_col)}", f"__c{names.index(text_col)}"
    alone = back(passes_filter(named(rows, F.col("__digest")), known, inverse=True))
    candidates = passes_filter(named(rows, F.col("__digest")), known).drop("digest")
    table = classes.filter("n_texts = 1").select(F.col("digest").alias("__digest"), F.col(f"{keep}_id").alias("__keep"), F.lit(True).alias("__there"), F.col("n").alias("__n"))
    met = salted_join(candidates.select("__digest", F.col(id_at).alias("__id")), table, ["__digest"], ["__id"], "left")
    stays = materialise(met.filter(F.col("__there").isNull() | F.col("__id").eqNullSafe(F.col("__keep"))).select("__digest", F.col("__id").alias("__i")).distinct(), "digest-stays")
    pair = lambda i: F.concat_ws("|", "__digest", F.coalesce(i.cast("string"), F.lit("")))
    maybe = passes_filter(candidates.withColumn("digest", pair(F.col(id_at))), filter_words(stays.select(pair(F.col("__i")).alias("digest")))).drop("digest")
    kept = maybe.join(stays.withColumnRenamed("__digest", "__d"), (F.col("__digest") == F.col("__d")) & F.col(id_at).eqNullSafe(F.col("__i")), "left_semi")
    collided = classes.filter("n_texts > 1").select(F.col("digest").alias("__d"), F.col("text").alias("__t"), F.col(f"{keep}_id").alias("__k"), F.lit(True).alias("__in"))
    if collided.limit(1).count():  # different texts under one digest
        text = F.coalesce(F.col(text_at), F.lit(""))
        kept = kept.join(collided, (F.col("__digest") == F.col("__d")) & (text == F.col("__t")), "left").filter(F.col("__in").isNull() | F.col(id_at).eqNullSafe(F.col("__k"))).drop("__d", "__t", "__k", "__in")
    # rows that repeat id and text; a single text that only seemed to have copies is among the candidates, too
    kept = kept.withColumn("__null", F.coalesce(F.col(text_at), F.lit(""))).dropDuplicates(["__digest", "__null", id_at]).drop("__null")
    return alone.select(names).unionByName(back(kept).select(names))
