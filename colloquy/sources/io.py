"""Readers and writers of the corpus formats. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from colloquy.sources.keyed import members

TARGET = "utterance string, speaker string, context array<string>, context_speakers array<string>, show string, sarcasm boolean"
UTTERANCE = "id string, conversation_id string, speaker string, text string, `reply-to` string"
SCENE = "season string, episode string, scene string"


def read_keyed_json(spark: SparkSession, path: str, value_schema: str, key: str = "id") -> DataFrame:
    """One JSON object (a file, or each file of a folder) as rows of (key, fields), read by many tasks; damaged text raises an error."""
    fields = F.from_json("value", f"struct<{_fields(value_schema)}>", {"mode": "FAILFAST"})
    return members(spark, path).select(F.col("key").alias(key), fields.alias("__v")).select(key, "__v.*")


def _fields(ddl: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (part.strip().split(" ", 1) for part in ddl.split(", ")))


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON lines; a damaged line raises an error, blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "errorifexists").json(path)


def read_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """CSV with a header, quoted line ends and doubled quotes; a byte-order mark is dropped."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def write_csv(rows: DataFrame, path: str, fields: list[str], unknown: str | None = None) -> None:
    """CSV with the given fields in order; further columns are dropped, nulls written as ``unknown`` if given."""
    out = rows.select(*fields)
    out.fillna(unknown).write.csv(path, header=True, escape='"') if unknown else out.write.csv(path, header=True, escape='"')


def write_partitioned(rows: DataFrame, path: str, *keys: str, replace: bool = False) -> None:
    """Parquet partitioned by the keys, each key's rows in few files.

    replace: keys that rows hold are replaced as a whole, all others stay, so one run may be made again. Without it,
    the folder must not exist.
    """
    out = rows.repartition(*keys).write.partitionBy(*keys)
    if replace:
        out = out.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.parquet(path)


def json_cell(value: Column) -> Column:
    return F.to_json(value)


def parse_json_cell(cell: Column, schema: str, default: Column) -> Column:
    return F.coalesce(F.from_json(F.when(cell != "", cell), schema), default)


def with_scenes(utterances: DataFrame, scenes: DataFrame, agree: dict[str, Column] | None = None) -> DataFrame:
    """Utterances with their scene's metadata; a missing scene raises an error, and so does metadata that differs from what the id says.

    agree: columns of scenes and what they must equal, in columns of utterances. The scene table is joined, not looked up row by row.
    """
    out = _with_scenes(utterances, scenes, agree or {})
    stop = lambda what: F.raise_error(F.concat(F.lit(what), F.col("conversation_id").cast("string"))).cast("boolean")
    wrong = F.lit(False)
    for column in agree or {}:
        wrong = wrong | ~F.col(f"__{column}")
    return out.filter(F.when(F.col("__there").isNull(), stop("no scene ")).when(wrong, stop("id and metadata disagree: ")).otherwise(True)).drop("__there", *(f"__{c}" for c in agree or {}))


def _with_scenes(utterances: DataFrame, scenes: DataFrame, agree: dict[str, Column]) -> DataFrame:
    return utterances.join(scenes.withColumn("__there", F.lit(True)), "conversation_id", "left").withColumns({f"__{c}": F.col(c).eqNullSafe(want) for c, want in agree.items()})


def scene_audit(utterances: DataFrame, scenes: DataFrame, agree: dict[str, Column]) -> DataFrame:
    """problem, n: utterances without a scene, and per column those of which the scene's metadata differs from what the id says."""
    out = _with_scenes(utterances, scenes, agree)
    counts = out.agg(F.count_if(F.col("__there").isNull()).alias("missing"), *(F.count_if(F.col("__there").isNotNull() & ~F.col(f"__{c}")).alias(c) for c in agree))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("problem"), F.col(c).alias("n")) for c in ("missing", *agree)))).alias("p")).select("p.*")


def in_order(rows: DataFrame, *columns: str) -> DataFrame:
    """rows in the order of an export: ranges of the columns over partitions, each sorted."""
    return rows.repartitionByRange(*columns).sortWithinPartitions(*columns)


def write_report(counts: DataFrame, path: str) -> None:
    """A small aggregate as one JSON file; it has one row per counter, so one task writes it."""
    counts.coalesce(1).write.json(path)


def read_turns(spark: SparkSession, turns: str, audio: str, dims: int) -> DataFrame:
    """Turns with their audio vectors, by source_index. A turn without a vector, a vector without a turn, or one of another length raises an error."""
    out = spark.read.parquet(turns).withColumn("__t", F.lit(True)).join(spark.read.parquet(audio), "source_index", "full")
    stop = lambda what: F.raise_error(F.concat(F.lit(what), F.col("source_index").cast("string"))).cast("boolean")
    good = F.when(F.col("__t").isNull(), stop("no turn ")).when(F.col("target_audio").isNull(), stop("no vector ")).when(F.size("target_audio") != dims, stop("a vector of another length ")).otherwise(True)
    return out.filter(good).drop("__t")


def counters(rows: DataFrame, column: str) -> DataFrame:
    """Counts of a column, the largest first, then by value."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)
