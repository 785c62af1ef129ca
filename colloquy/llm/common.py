"""Helpers shared by the corpus operators: reading, shared storage and checked broadcasts."""

from __future__ import annotations

import tempfile
import threading
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes (written as JSON) up to which a table may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders made where no shared one is named and all executors are threads of the driver.
_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local master (tests) gets a folder of its own; a cluster gets an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="colloquy-"))
    return _LOCAL[0]


class _Named(threading.local):
    """Folders that this thread has named in the shared folder, in order."""

    def __init__(self):
        self.folders: list[str] = []


_NAMED = _Named()


def new_path(spark: SparkSession, name: str) -> str:
    _NAMED.folders.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _NAMED.folders[-1]


def whole_ids(df: DataFrame, id_col: str) -> Column:
    """The id column as long. Ids of another kind than whole numbers raise an error, since a cast would make them null."""
    kind = df.schema[id_col].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise TypeError(f"ids are whole numbers; {id_col} is {kind}")
    return F.col(id_col).cast("long")


#: Spark's setting to delete the shuffle files of an execution when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts the lineage and survives lost executors.

    The write's shuffle files go when it has ended: nothing reads them again, since the table is there.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[id(back)] = (weakref.ref(back, lambda _, key=id(back): _WRITTEN.pop(key, None)), path)
    return back


#: Folders of materialised tables that are still referred to.
_WRITTEN: dict[int, tuple[weakref.ref, str]] = {}


def discard(*tables: DataFrame) -> None:
    """Delete the folders of materialised tables whose readers have been written themselves."""
    for df in tables:
        known = _WRITTEN.pop(id(df), None)
        if known and known[0]() is df:
            _delete(df.sparkSession, known[1])


def _delete(spark: SparkSession, folder: str) -> None:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def folders_named() -> int:
    return len(_NAMED.folders)


def release(spark: SparkSession, since: int, *keep: str) -> None:
    """Delete the folders that this thread has named after the first ``since`` of them, but those to keep. What was made from them has been written."""
    for folder in _NAMED.folders[since:]:
        if folder not in keep:
            _delete(spark, folder)
    _NAMED.folders[since:] = keep


def only_written(df: DataFrame, name: str, since: int) -> DataFrame:
    """df written like materialise does; then all other folders named after the first ``since`` are deleted, which df was made from."""
    out = materialise(df, name)
    release(df.sparkSession, since, _NAMED.folders[-1])
    return out


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast of a materialised table if it has few enough rows and bytes; beyond that Spark shuffles both sides."""
    n, held = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(df) if n <= rows and (held or 0) <= size else df


#: Rows of one key from which a join deals them over several tasks, and keys at most that are dealt so (rows / HOT_KEYS is the other bound).
HOT_ROWS, HOT_KEYS = 500, 4096


def salted_join(rows: DataFrame, table: DataFrame, keys: list[str], spread: list[Column | str], how: str = "inner", total: int | None = None) -> DataFrame:
    """rows joined with a table of one row per key, whose column ``__n`` says how many rows have the key.

    Keys with many rows are dealt over salts by a hash of the spread columns, and the table's row of such a key is
    repeated once a salt. At most HOT_KEYS keys are that frequent, so their list is broadcast. total: rows in all, if known.
    """
    total = table.agg(F.sum("__n")).first()[0] or 0 if total is None else total
    most = max(HOT_ROWS, total // HOT_KEYS)
    names = [f"__k{i}" for i in range(len(keys))]
    hot = F.broadcast(table.filter(F.col("__n") > most).select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.ceil(F.col("__n") / most).cast("long").alias("__salts")))

    def with_hot(df: DataFrame) -> DataFrame:
        on = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
        return df.join(hot, on, "left").drop(*names)

    dealt = with_hot(rows).withColumn("__salt", F.when(F.col("__salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*spread), F.col("__salts")))).drop("__salts")
    each = with_hot(table.filter(F.col("__n") > most)).withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__salts") - 1))).drop("__salts")
    each = each.unionByName(table.filter(F.col("__n") <= most).withColumn("__salt", F.lit(0).cast("long")))
    return dealt.join(each.drop("__n"), [*keys, "__salt"], how).drop("__salt")
