"""Turn-level operators: runs, contexts, next turns, sealed ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sealed(turns: DataFrame, end: int | Column) -> DataFrame:
    """Only rows before the given position may be used."""
    return turns.filter(F.col("source_index") < end)


def with_runs(turns: DataFrame) -> DataFrame:
    """run: turns of one dialogue label without a gap share a run; a label that comes back later starts a new one."""
    w = Window.partitionBy("dialogue_id").orderBy("source_index")
    return turns.withColumn("run", F.col("source_index") - F.row_number().over(w))


def eligible(turns: DataFrame, context_turns: int = 5) -> DataFrame:
    """Turns with a text whose next position, in the same dialogue, has a text too; with that reply and their context.

    The context is that of the last context_turns positions of the run, the turn itself included, without blank ones.
    Runs nest in dialogues, so all windows share one exchange.
    """
    order = Window.partitionBy("dialogue_id").orderBy("source_index")
    run = Window.partitionBy("dialogue_id", "run").orderBy("source_index")
    out = with_runs(turns).withColumns(
        {
            "next_index": F.lead("source_index").over(order),
            "response": F.lead("text").over(order),
            "next_speaker": F.lead("speaker").over(order),
            "context_turns": F.filter(F.collect_list(F.struct("speaker", "text")).over(run.rowsBetween(1 - context_turns, 0)), lambda t: t["text"].isNotNull()),
        }
    )
    out = out.filter(F.col("text").isNotNull() & F.col("response").isNotNull() & (F.col("next_index") == F.col("source_index") + 1))
    return out.select("source_index", "dialogue_id", "episode_id", F.col("label").alias("target_label"), "speaker", "text", "next_speaker", "response", "context_turns")


def context_before(utterances: DataFrame, window: int = 8) -> DataFrame:
    """context: the rows among the window positions before an utterance that have words and are no notes, oldest first.

    Rows without words and notes use up a place. utterances: conversation_id, order, speaker, text, text_norm (the
    normalised text, which says whether there are words).
    """
    w = Window.partitionBy("conversation_id").orderBy("order").rowsBetween(-window, -1)
    said = F.collect_list(F.struct("order", "speaker", "text", "text_norm")).over(w)
    return utterances.withColumn("context", F.filter(said, lambda r: (r["text_norm"] != "") & (r["speaker"] != "TRANSCRIPT_NOTE")))


def scene_positions(utterances: DataFrame) -> DataFrame:
    return utterances.withColumn("position", F.row_number().over(Window.partitionBy("conversation_id").orderBy("order")) - 1)
