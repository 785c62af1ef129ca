"""Conversation-corpus tables as views over the given tables, in Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.hashing import bucket, stable_int
from colloquy.functions.text import clean

METHODS, SEEDS = ("fusion", "lexical"), (11, 12)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn table: source_index, speaker, text (null if blank), label, episode_id, dialogue_id."""
    key = F.concat_ws("|", "conv_id", "turn")
    episode = F.concat(F.lit("E"), F.lpad(F.floor(F.col("conv_id") / 10).cast("string"), 5, "0"))
    return read(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("source_index"), F.concat(F.lit("spk"), bucket(key, "speaker", 3)).alias("speaker"), clean(F.col("text")).alias("text"),
        bucket(key, "label", 2).alias("label"), episode.alias("episode_id"), F.concat_ws("-", episode, "conv_id").alias("dialogue_id"),
    )


def audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_index, target_audio."""
    vectors = read(spark, sf_dir, "embeddings")
    count = vectors.agg(F.count(F.lit(1)).alias("n"))
    index = turns(spark, sf_dir).select("source_index").join(F.broadcast(count))  # one row
    index = index.select("source_index", (stable_int(F.col("source_index"), "audio") % F.col("n")).cast("long").alias("vec_id"))
    return index.join(vectors, "vec_id").select("source_index", F.col("embedding").alias("target_audio"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances: conversation_id, order, utterance_id, speaker, text."""
    lines = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("conversation_id"), F.posexplode(F.split("text", "\n", -1)).alias("order", "text"))
    key = F.concat_ws("|", "conversation_id", "order")
    return lines.select("conversation_id", "order", key.alias("utterance_id"), F.concat(F.lit("spk"), bucket(key, "speaker", 3)).alias("speaker"), "text")


def targets(lines: DataFrame) -> DataFrame:
    """Targets cut from corpus lines: target_id, utterance, speaker, context (up to two lines), context_speakers, label."""
    from pyspark.sql import Window

    w = Window.partitionBy("conversation_id").orderBy("order").rowsBetween(-2, -1)
    drawn = lines.withColumns({"context": F.collect_list("text").over(w), "context_speakers": F.collect_list("speaker").over(w), "draw": bucket(F.col("utterance_id"), "target", 50), "more": bucket(F.col("utterance_id"), "cut", 8)})
    drawn = drawn.filter("draw < 2 and length(text) > 1")
    # one in eight of the second kind loses two characters more, so that few of these have an exact row
    cut = F.when((F.col("more") == 0) & (F.length("text") > 3), 3).otherwise(1)
    utterance = F.when(F.col("draw") == 0, F.concat("text", F.lit("!"))).otherwise(F.substring("text", F.lit(1), F.length("text") - cut))
    return drawn.select(F.concat(F.lit("t|"), "utterance_id").alias("target_id"), utterance.alias("utterance"), "speaker", "context", "context_speakers", (bucket(F.col("utterance_id"), "label", 2) == 1).alias("label"))


def predictions(records: DataFrame) -> DataFrame:
    """Recognition predictions of (source_index, target_label, …) per method, fold and seed: labels flipped in three of ten cases."""
    grid = records.select("source_index", "dialogue_id", "episode_id", F.col("target_label").alias("true_label"), "fold", F.explode(F.array(*map(F.lit, METHODS))).alias("method")).withColumn("seed", F.explode(F.array(*map(F.lit, SEEDS))))

    def flipped(kind: str):
        key = F.concat_ws("|", F.lit(kind), "method", "fold", "seed", "source_index")
        return F.when(bucket(key, "rec", 10) < 3, 1 - F.col("true_label")).otherwise(F.col("true_label"))

    return grid.withColumns({"text_label": flipped("text"), "text_audio_label": flipped("audio")})


def scores(candidates: DataFrame) -> DataFrame:
    """Candidate scores per method, seed and condition of candidate rows with fold, sample_id, candidate_id."""
    grid = candidates.withColumn("method", F.explode(F.array(*map(F.lit, METHODS)))).withColumn("seed", F.explode(F.array(*map(F.lit, SEEDS)))).withColumn("condition", F.explode(F.array(F.lit("text"), F.lit("text_audio"))))
    key = F.concat_ws("|", "method", "fold", "seed", "sample_id", "candidate_id", "condition")
    return grid.withColumn("selector_logit", bucket(key, "score", 1_000_000) / F.lit(1e6))


def h(expression: str) -> str:
    """DuckDB: the hash of ``salt|value`` text."""
    return f"(('0x' || substr(sha256({expression}), 1, 16))::UBIGINT)"


SQL = {
    "turns": f"""turns AS (SELECT conv_id * 1000 + turn AS source_index, 'spk' || ({h("'speaker|' || conv_id || '|' || turn")} % 3) AS speaker,
        nullif(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '') AS text, ({h("'label|' || conv_id || '|' || turn")} % 2)::INT AS label,
        'E' || lpad((conv_id // 10)::VARCHAR, 5, '0') AS episode_id, 'E' || lpad((conv_id // 10)::VARCHAR, 5, '0') || '-' || conv_id AS dialogue_id FROM conversations)""",
    "audio": f"""audio AS (SELECT t.source_index, e.embedding AS target_audio FROM turns t
        JOIN embeddings e ON e.vec_id = ({h("'audio|' || t.source_index")} % (SELECT count(*) FROM embeddings))::BIGINT)""",
    "corpus": f"""lines AS (SELECT doc_id AS conversation_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS "order" FROM documents),
        corpus AS (SELECT conversation_id, "order", conversation_id || '|' || "order" AS utterance_id, 'spk' || ({h("'speaker|' || conversation_id || '|' || " + '"order"')} % 3) AS speaker, text FROM lines)""",
}
