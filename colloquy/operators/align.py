"""Alignment of labelled targets to a corpus, and the reply that follows.

Blocks: rows with the target's exact normalised text, if there are any; else rows that share a token with it (and its
speaker, if known); else, for short targets, all rows of the speaker, or all rows. Block pairs are scored by text
similarity, then by the context before them and the speaker; the best becomes the alignment. Target ids and utterance
ids are unique; of an utterance id that isn't, no reply is told.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from colloquy.functions.blocks import allowed, lengths, meeting, near, signatures
from colloquy.functions.evidence import Contexts, Kept, Said, by_text, column, numbers
from colloquy.functions.text import normalise, percent, tags
from colloquy.operators.audit import concentration, violations
from colloquy.operators.turns import context_before, scene_positions
from colloquy.sources.storage import written

# Thresholds of a match, of high evidence, and of short targets; positions of context.
REASONABLE, TARGET_HIGH, CONTEXT1_HIGH, CONTEXT2_HIGH = 0.80, 0.95, 0.90, 0.80
SHORT, WINDOW = 12, 8
#: Ratio of neighbouring length classes.
CLASS = 1.2
#: Rows of a frequent text that one salt has.
SALT_ROWS = 1000
#: Rows of a block in which targets meet the rows of their texts, on average, and pairs of a frequent text in one.
MEET_ROWS, MEET_PAIRS = 1 << 13, 1 << 24
#: Rows and characters of a block on average, and (speaker, length class) pairs that every task may hold.
BLOCK_ROWS, BLOCK_CHARACTERS, FEW_CLASSES = 1 << 14, 1 << 22, 20_000
# Names of the levels of a match.
LEVELS = {"exact": "LEVEL_A_EXACT", "high": "LEVEL_B_HIGH_CONFIDENCE", "ambiguous": "LEVEL_C_AMBIGUOUS", "none": "NO_MATCH"}


def prepared_corpus(corpus: DataFrame, exact: bool = True) -> DataFrame:
    """corpus with text_norm and text_norm_noapos."""
    return corpus.withColumns({"text_norm": normalise(F.col("text"), exact=exact), "text_norm_noapos": normalise(F.col("text"), False, exact)})


def prepared_targets(targets: DataFrame, exact: bool = True) -> DataFrame:
    return targets.withColumn("target_norm", normalise(F.col("utterance"), exact=exact))


def exact_block(targets: DataFrame, corpus: DataFrame) -> DataFrame:
    """targets with the rows of their exact text. The rows of a frequent text are dealt over salts, and its targets meet each of them, so no task makes all pairs of a text."""
    rows = corpus.filter("text_norm <> ''").select("utterance_id", "conversation_id", "order", F.col("speaker").alias("corpus_speaker"), "text_norm")
    asked = targets.filter("target_norm <> ''").select(F.col("target_norm").alias("text_norm"))
    often = rows.groupBy("text_norm").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SALT_ROWS).join(asked, "text_norm", "left_semi")
    often = written(often.select(F.col("text_norm").alias("__text"), F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("__salts")), "frequent-texts")
    often = F.broadcast(often) if often.count() <= FEW_CLASSES else often
    rows = rows.join(often, F.col("text_norm") == F.col("__text"), "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64("utterance_id"), "__salts").cast("int"), F.lit(0))).drop("__text", "__salts")
    each = targets.join(often, F.col("target_norm") == F.col("__text"), "left").withColumn("__salt_of", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__text", "__salts")
    return each.join(rows, (F.col("target_norm") == F.col("text_norm")) & (F.col("__salt_of") == F.col("__salt"))).drop("__salt", "__salt_of")


def _words(text: str) -> Column:
    return F.array_distinct(F.filter(F.split(text, " "), lambda w: w != ""))


def _class(length: Column) -> Column:
    return F.floor(F.log(length.cast("double")) / math.log(CLASS)).cast("int")


def in_blocks(targets: DataFrame, corpus: DataFrame, run: Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]], schema: str, least: float = REASONABLE) -> DataFrame:
    """What run makes of each block: targets (target_id, target_norm), and rows (utterance_id, text_norm) of their speaker, if known, of which some have a length that allows a match.

    A similarity of least bounds the ratio of lengths, so rows are dealt by (speaker, length class), and a class by ids
    into blocks of BLOCK_ROWS rows or BLOCK_CHARACTERS on average. A target is sent to all blocks of the classes that its
    length allows, so it meets each row once.
    """
    n, m = F.length("target_norm"), F.length("text_norm")
    bounds = [_class(F.greatest(F.floor(n * least / (2 - least)), F.lit(1))), _class(F.ceil(n * (2 - least) / least) + 1)]
    left = targets.filter("target_norm <> ''").select("target_id", "target_norm", "speaker", F.explode(F.sequence(*bounds)).alias("class"))
    right = corpus.filter("text_norm <> ''").select("utterance_id", "text_norm", F.coalesce("speaker", F.lit("")).alias("by"), F.col("speaker").isNotNull().alias("named"), _class(m).alias("class"))
    key = ["class", "named", "by"]
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum(m) / BLOCK_CHARACTERS))
    sizes = written(right.groupBy(*key).agg(parts.cast("int").alias("parts")), "block-sizes")
    right = right.join(F.broadcast(sizes) if sizes.count() <= FEW_CLASSES else sizes, key).withColumn("part", F.pmod(F.xxhash64("utterance_id"), "parts").cast("int")).drop("parts")
    known = left.filter("speaker is not null").withColumns({"by": F.col("speaker"), "named": F.lit(True)}).join(sizes, key)
    asked = known.unionByName(left.filter("speaker is null").join(sizes, "class"), allowMissingColumns=True).select("target_id", "target_norm", *key, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    # few bytes but much work, so they keep all partitions
    dealt = lambda df: df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key, "part").groupBy(*key, "part")

    def met(asked: pa.Table, held: pa.Table) -> Iterator[pa.RecordBatch]:
        if asked.num_rows and held.num_rows:
            yield from run(asked, held)

    return dealt(asked).cogroup(dealt(right)).applyInArrow(_tables(met, schema), schema)


def _tables(run, schema: str):
    """run's batches as one table, empty if there are none."""
    kind = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(schema).fields])

    def whole(asked: pa.Table, held: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(run(asked, held)), kind)

    return whole


def _texts(table: pa.Table, column: str) -> pa.Array:
    return table[column].combine_chunks().cast(pa.string())


def token_counts(targets: DataFrame, corpus: DataFrame, least: float = REASONABLE, signed: bool = False) -> DataFrame:
    """target_id, pairs and, if signed, allowed: how many rows share a token with a target and, if its speaker is known, the speaker, and have a length that allows a match; of how many the counts of characters allow one. Targets without pairs are left out.

    Pairs are counted where they meet, none is made.
    """

    def run(asked: pa.Table, held: pa.Table) -> Iterator[pa.RecordBatch]:
        a, b = _texts(asked, "target_norm"), _texts(held, "text_norm")
        pairs, kept = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        of_a, of_b, n, m = (signatures(a), signatures(b), lengths(a), lengths(b)) if signed else (None,) * 4
        for i, rows in meeting(a, b, least):
            pairs[i] = len(rows)
            if signed:
                kept[i] = allowed(of_a[i], of_b[rows], n[i] + m[rows], least).sum()
        found = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([asked["target_id"].take(pa.array(found)).combine_chunks(), pa.array(pairs[found]), pa.array(kept[found])], ["target_id", "pairs", "allowed"])

    met = in_blocks(targets, corpus, run, f"target_id {targets.schema['target_id'].dataType.simpleString()}, pairs long, allowed long", least)
    return met.groupBy("target_id").agg(*(F.sum(c).alias(c) for c in ("pairs", "allowed")[: 1 + signed]))


def inexact(targets: DataFrame, corpus: DataFrame) -> DataFrame:
    """Targets without a row in the exact block."""
    return targets.join(corpus.filter("text_norm <> ''").select(F.col("text_norm").alias("target_norm")), "target_norm", "left_anti")


def without_token_mates(targets: DataFrame, corpus: DataFrame) -> DataFrame:
    """Targets with which no row (of their speaker, if known) shares a token, whatever its length."""
    asked = targets.select("target_id", "speaker", F.explode(_words("target_norm")).alias("token"))
    held = corpus.select(F.col("speaker").alias("corpus_speaker"), F.explode(_words("text_norm")).alias("token")).join(asked.select("token").distinct(), "token", "left_semi").distinct()
    known = asked.filter("speaker is not null").join(held.withColumnRenamed("corpus_speaker", "speaker"), ["token", "speaker"], "left_semi")
    anyone = asked.filter("speaker is null").join(held, "token", "left_semi")
    return targets.join(known.select("target_id").unionByName(anyone.select("target_id")).distinct(), "target_id", "left_anti")


def fallback_counts(targets: DataFrame, corpus: DataFrame, least: float = REASONABLE) -> DataFrame:
    """target_id, pairs: how many rows of the speaker (or of all) have a length that allows a match, for short targets. Targets meet counts of rows by speaker and length, so no pair is made."""
    short = targets.filter((F.length("target_norm") <= SHORT) & (F.col("target_norm") != "")).select("target_id", "speaker", F.length("target_norm").alias("n"))
    sizes = F.sequence(F.floor(F.col("n") * least / (2 - least)).cast("int"), F.ceil(F.col("n") * (2 - least) / least).cast("int"))
    asked = short.withColumn("m", F.explode(sizes)).filter(2 * F.least("n", "m") >= least * (F.col("n") + F.col("m")))
    rows = corpus.groupBy(F.col("speaker"), F.length("text_norm").alias("m")).agg(F.count(F.lit(1)).alias("k"))
    known = asked.filter("speaker is not null").join(rows, ["speaker", "m"])
    anyone = asked.filter("speaker is null").drop("speaker").join(rows.groupBy("m").agg(F.sum("k").alias("k")), "m")
    return known.select("target_id", "k").unionByName(anyone.select("target_id", "k")).groupBy("target_id").agg(F.sum("k").alias("pairs"))


def near_texts(targets: DataFrame, texts: DataFrame, words: bool = True, least: float = REASONABLE) -> DataFrame:
    """target_id, text_norm, by, target_sim: texts (speaker, text_norm) of at least this similarity with a target, of its speaker, if known, and with a token of it, if words. Texts are compared where they meet, and only those found become rows."""

    def run(asked: pa.Table, held: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, names = asked["target_id"].combine_chunks(), pa.table({"text_norm": _texts(held, "text_norm"), "by": pc.if_else(held["named"], held["by"], None)})
        for i, found, sims in near(_texts(asked, "target_norm"), _texts(held, "text_norm"), least, words):
            if len(found):
                some = names.take(pa.array(found)).combine_chunks()
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.full(len(found), i))), some["text_norm"].combine_chunks(), some["by"].combine_chunks().cast(pa.string()), pa.array(sims)], ["target_id", "text_norm", "by", "target_sim"])

    return in_blocks(targets, texts.withColumn("utterance_id", F.xxhash64("text_norm")), run, f"target_id {targets.schema['target_id'].dataType.simpleString()}, text_norm string, by string, target_sim double", least)


def asked_texts(targets: DataFrame, corpus: DataFrame) -> DataFrame:
    """target_id, text_norm, by, restricted, exact, target_sim: the texts at REASONABLE or above that each target asks for; of a restricted one only the rows whose speaker is by."""
    texts = written(corpus.filter("text_norm <> ''").select("speaker", "text_norm").distinct(), "texts")
    exact = targets.filter("target_norm <> ''").join(texts.select(F.col("text_norm").alias("target_norm")), "target_norm", "left_semi")
    left = written(inexact(targets, texts), "inexact-targets")
    short = left.filter((F.length("target_norm") <= SHORT) & (F.col("target_norm") != ""))
    fuzzy = near_texts(left, texts).unionByName(near_texts(written(without_token_mates(short, texts), "lone-targets"), texts, words=False))
    none = F.lit(None).cast("string")
    exact = exact.select("target_id", F.col("target_norm").alias("text_norm"), none.alias("by"), F.lit(False).alias("restricted"), F.lit(True).alias("exact"), F.lit(1.0).alias("target_sim"))
    return exact.unionByName(fuzzy.select("target_id", "text_norm", "by", F.lit(True).alias("restricted"), F.lit(False).alias("exact"), "target_sim"))


def by_texts(asked: DataFrame, rows: DataFrame, run: Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]], schema: str, most: int | None = None) -> DataFrame:
    """What run makes of blocks of rows (utterance_id, text_norm and more) and the targets that ask for their texts. Both are written tables.

    Texts are dealt over blocks of most rows on average, several a task. Rows and targets of a frequent text are dealt
    over salts, and each meets all salts of the other side, so a block has no more than MEET_PAIRS of its pairs.
    """
    most = most or MEET_ROWS
    some = max(1, MEET_PAIRS // most)
    often = rows.groupBy("text_norm").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > min(some, most))
    often = often.join(asked.groupBy("text_norm").agg(F.count(F.lit(1)).alias("k")), "text_norm")
    salts = {"salts": F.ceil(F.col("n") / most), "shares": F.when(F.col("n") * F.col("k") > MEET_PAIRS // 8, F.ceil(F.col("k") / some)).otherwise(1)}
    often = written(often.select(F.col("text_norm").alias("__text"), *(n.cast("int").alias(c) for c, n in salts.items())).filter("salts > 1 or shares > 1"), "frequent-texts")
    few = F.broadcast(often) if often.count() <= FEW_CLASSES else often
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / most))
    own = lambda df: df.join(few, F.col("text_norm") == F.col("__text"), "left").drop("__text")
    one = lambda key, n: F.coalesce(F.pmod(F.xxhash64(key), n).cast("int"), F.lit(0))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    held = own(rows).withColumn("salt", one("utterance_id", "salts")).withColumn("share", each("shares"))
    sent = own(asked).withColumn("share", one("target_id", "shares")).withColumn("salt", each("salts"))
    block = F.pmod(F.xxhash64("text_norm", "salt", "share"), F.lit(4 * parts)).cast("int")
    # few bytes but much work, so they keep all partitions
    dealt = lambda df: df.withColumn("__block", block).drop("salts", "shares").repartition(parts, "__block").groupBy("__block")

    def met(asked: pa.Table, held: pa.Table) -> Iterator[pa.RecordBatch]:
        if asked.num_rows and held.num_rows:
            yield from run(asked, held)

    return dealt(sent).cogroup(dealt(held)).applyInArrow(_tables(met, schema), schema)


def kept_schema(targets: DataFrame, corpus: DataFrame) -> str:
    """The columns of ``Kept.batch``."""
    kind = {"utterance_id": corpus.schema["utterance_id"].dataType.simpleString(), "exact": "boolean", "speaker_match": "boolean"}
    fields = ", ".join(f"{k}_{f} {kind.get(f, 'double')}" for k in Kept.KINDS for f in Kept.FIELDS)
    return f"target_id {targets.schema['target_id'].dataType.simpleString()}, num_candidates long, num_high long, num_exact long, {fields}"


def merged(kept: DataFrame) -> DataFrame:
    """Per target: num_candidates, num_high, num_exact, best, best_high and best_exact of what its blocks kept."""
    row = lambda k: F.when(F.col(f"{k}_evidence").isNotNull(), F.struct(*(F.col(f"{k}_{f}").alias(f) for f in Kept.FIELDS)))
    return kept.groupBy("target_id").agg(*(F.sum(c).alias(c) for c in ("num_candidates", "num_high", "num_exact")), *(F.max(row(k)).alias(k) for k in Kept.KINDS))


def with_evidence(asked: DataFrame, targets: DataFrame, corpus: DataFrame) -> DataFrame:
    """``merged`` of the pairs of targets and the rows of the texts that they ask for. context1 and context2 are the similarities of a target's last line of context and of the one before to the best row before (0 without one); evidence is the least of these and the text's.

    A pair of which all context lines have equal rows tells how good a target's best evidence is at least. A pair that
    can neither reach that nor be of high evidence is not selected, so its context is not compared, and for the others
    similarities below are not worked out: both count as 0 then. No pair becomes a row.
    """
    wanted = asked.select("text_norm").distinct()
    size = wanted.count()
    before = context_before(corpus, WINDOW).join(F.broadcast(wanted) if size <= FEW_CLASSES else wanted, "text_norm", "left_semi")
    rows = written(before.select("utterance_id", "text_norm", "speaker", F.col("context.text_norm").alias("said"), F.col("context.speaker").alias("who")), "rows-met")
    lines = targets.select("target_id", "speaker", *(normalise(F.try_element_at("context", F.lit(-k))).alias(f"line{k}") for k in (1, 2)), *(F.try_element_at("context_speakers", F.lit(-k)).alias(f"by{k}") for k in (1, 2)), F.size("context").alias("n_context"))
    asked = written(asked.join(lines, "target_id"), "asked-texts")
    name = targets.schema["target_id"].dataType.simpleString()

    def equal(asked: pa.Table, held: pa.Table) -> Iterator[pa.RecordBatch]:
        contexts, n, sims = Contexts(asked, held, 0), numbers(asked, "n_context"), numbers(asked, "target_sim")
        found = [i for some, rows in by_text(asked, held) for i in some if contexts.sure(i, contexts.rows_of(i, rows)[0], n[i])]
        yield pa.RecordBatch.from_arrays([column(asked, "target_id").take(pa.array(found, pa.int64())), pa.array(sims[found])], ["target_id", "floor"])

    mark = lambda c: F.when(F.length(c) == 0, 0).otherwise(F.xxhash64(c))
    marked = asked.withColumns({c: mark(F.col(c)) for c in ("line1", "line2")})
    floors = by_texts(marked, rows.withColumn("said", F.transform("said", mark)), equal, f"target_id {name}, floor double").groupBy("target_id").agg(F.max("floor").alias("floor"))

    def decide(asked: pa.Table, held: pa.Table) -> Iterator[pa.RecordBatch]:
        contexts, kept, exact, n, sims, floors = Contexts(asked, held, ""), Kept(held), *(numbers(asked, c) for c in ("exact", "n_context", "target_sim", "floor"))
        texts = Said(contexts.values)
        for some, rows in by_text(asked, held):
            for i in some:
                mine, match = contexts.rows_of(i, rows)
                if not len(mine):
                    continue
                may_be_high, other = match & (sims[i] >= TARGET_HIGH), floors[i] if sims[i] >= floors[i] else 2.0
                needed = lambda high, f=floors[i], m=may_be_high, o=other: np.where(m, min(f, high), o)
                context1, context2 = np.zeros(len(mine)), np.zeros(len(mine))
                if n[i] >= 1:
                    context1, at = contexts.best(i, 1, mine, needed(CONTEXT1_HIGH), texts)
                    more = np.flatnonzero((at >= 0) & (context1 >= needed(CONTEXT1_HIGH))) if n[i] >= 2 else []
                    if len(more):
                        context2[more] = contexts.best(i, 2, mine[more], needed(CONTEXT2_HIGH)[more], texts, at[more])[0]
                evidence = np.minimum(sims[i], context1) if n[i] < 2 else np.minimum(np.minimum(sims[i], context1), context2)
                high = may_be_high & (n[i] >= 1) & (context1 >= CONTEXT1_HIGH) & ((n[i] < 2) | (context2 >= CONTEXT2_HIGH))
                kept.pairs(i, mine, match, evidence, sims[i], context1, context2, bool(exact[i]), high)
        yield kept.batch(asked)

    ready = written(asked.join(floors, "target_id", "left").fillna({"floor": 0.0}), "asked-floors")
    return merged(by_texts(ready, rows, decide, kept_schema(targets, corpus)))


def decided(per: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target: alignment_type, status, the selected utterance with its scores, counts and notes. per: what ``merged`` gives.

    The only exact row of high evidence is selected, else the only row of high evidence, else the row of the best evidence.
    """
    out = targets.select("target_id", "speaker", F.size("context").alias("n_context")).join(per, "target_id", "left")
    exact, unique = F.col("num_exact") == 1, F.col("num_high") == 1
    level = F.when(F.col("best").isNull(), LEVELS["none"]).when(exact, LEVELS["exact"]).when(unique, LEVELS["high"]).otherwise(LEVELS["ambiguous"])
    status = F.when(F.col("best").isNull(), "REJECTED").when(exact, "AUTO_CANDIDATE").otherwise("MANUAL_REVIEW_REQUIRED")
    out = out.withColumns({"alignment_type": level, "status": status, "selected": F.when(exact, F.col("best_exact")).when(unique, F.col("best_high")).otherwise(F.col("best"))})
    s = lambda f: F.col(f"selected.{f}")
    found = F.col("selected").isNotNull()
    notes = tags(
        unresolved_speaker=F.col("speaker").isNull(), multiple_high_confidence_candidates=F.col("num_high") > 1, no_candidate_at_or_above_reasonable_threshold=~found,
        target_similarity_below_high_threshold=found & (s("target_sim") < TARGET_HIGH), speaker_not_verified=found & ~s("speaker_match"),
        context1_below_high_threshold=found & (s("context1") < CONTEXT1_HIGH), context2_below_high_threshold=found & (F.col("n_context") >= 2) & (s("context2") < CONTEXT2_HIGH),
    )
    return out.select("target_id", "alignment_type", "status", s("utterance_id").alias("utterance_id"), *(F.round(F.coalesce(s(f), F.lit(0.0)), 6).alias(f) for f in ("target_sim", "context1", "context2", "evidence")), F.coalesce("num_candidates", F.lit(0)).alias("num_candidates"), F.coalesce("num_high", F.lit(0)).alias("num_high"), notes.alias("notes"))


def aligned(targets: DataFrame, corpus: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """The alignment of targets (target_id, utterance, speaker, context, context_speakers) to corpus rows.

    names: alias and name of speakers; speakers that it doesn't resolve count as unknown. Without it, speakers of both
    tables have the same names. corpus may be a written table with text_norm. Normalised texts and the texts that targets ask for are written once and read by all steps behind them.
    """
    t = prepared_targets(renamed(targets, names) if names is not None else targets)
    t = written(t, "targets")
    c = corpus if "text_norm" in corpus.columns else written(prepared_corpus(corpus).drop("text_norm_noapos"), "corpus")
    out = written(decided(with_evidence(written(asked_texts(t, c), "texts-asked"), t, c), t), "decided")
    said = context_before(c, WINDOW).select("utterance_id", *(F.try_element_at(F.transform("context", lambda r: r["text"]), F.lit(-k)).alias(f"prev{k}") for k in (1, 2)))
    said = said.join(out.select("utterance_id").distinct(), "utterance_id", "left_semi").dropDuplicates(["utterance_id"])
    return out.join(said, "utterance_id", "left").select(*out.columns[:-1], "prev1", "prev2", "notes")


def observed_reply(alignment: DataFrame, corpus: DataFrame, text: bool = True) -> DataFrame:
    """The first later row of another speaker that is neither blank nor a note, or why there is none.

    Rows without text and notes are skipped before speakers are compared. A range join over the scene would be
    quadratic in long scenes; here, per row, the next row with text of another speaker comes from windows: speaker runs
    over the rows with text, and the first row of the next run. Texts don't take part in any of this: the replies' are
    fetched at the end, if text.
    """
    norm = F.col("text_norm") if "text_norm" in corpus.columns else normalise(F.col("text"))
    said = ((norm != "") & (F.col("speaker") != "TRANSCRIPT_NOTE")).alias("said")
    rows = scene_positions(corpus.select("conversation_id", "order", "utterance_id", "speaker", said))
    scene = Window.partitionBy("conversation_id").orderBy("position")
    later = scene.rowsBetween(1, Window.unboundedFollowing)
    said = F.when(F.col("said"), F.struct("position", "utterance_id", "speaker"))
    rows = rows.withColumns({"last": F.max("position").over(Window.partitionBy("conversation_id")), "texts_after": F.coalesce(F.sum(F.col("said").cast("long")).over(later), F.lit(0)), "next": F.first(said, ignorenulls=True).over(later)})
    valid = rows.filter("said").withColumn("__new", F.lag("speaker").over(scene))
    valid = valid.withColumn("__run", F.sum(F.when(F.col("__new").eqNullSafe(F.col("speaker")), 0).otherwise(1)).over(scene))
    heads = valid.groupBy("conversation_id", "__run").agg(F.min(F.struct("position", "utterance_id", "speaker")).alias("head"), F.count(F.lit(1)).alias("run_size"), F.max("position").alias("run_end"))
    order = Window.partitionBy("conversation_id").orderBy("__run")
    heads = heads.withColumns({"after": F.lead("head").over(order)})
    run_of = valid.select("conversation_id", F.col("position").alias("__p"), "__run", F.row_number().over(Window.partitionBy("conversation_id", "__run").orderBy("position")).alias("place"))
    runs = run_of.join(heads, ["conversation_id", "__run"])
    own = runs.select("conversation_id", "__p", "after", F.col("head.speaker").alias("run_speaker"), (F.col("run_size") - F.col("place")).alias("same_left"), "place", "run_size", "head")
    # a row whose next row with text has another speaker is answered by that one; else by the head of the run after
    here = rows.alias("r").join(own.alias("o"), (F.col("r.conversation_id") == F.col("o.conversation_id")) & (F.col("r.next.position") == F.col("o.__p")), "left")
    direct = F.col("r.next.speaker") != F.col("r.speaker")
    reply = F.when(direct, F.col("r.next")).otherwise(F.col("o.after"))
    same = F.when(F.col("r.next").isNull() | direct, 0).otherwise(F.col("o.run_size") - F.col("o.place") + 1)
    table = here.select("r.utterance_id", "r.conversation_id", "r.position", reply.alias("reply"), same.alias("skipped_same"), (F.col("r.last") - F.col("r.position") - F.col("r.texts_after")).alias("blank_after"))
    unique = table.groupBy("utterance_id").agg(F.count(F.lit(1)).alias("copies"), F.first(F.struct("conversation_id", "position", "reply", "skipped_same", "blank_after")).alias("t"))
    out = alignment.join(unique, "utterance_id", "left")
    t = lambda f: F.col(f"t.{f}")
    reason = (
        F.when(F.col("alignment_type") == LEVELS["none"], "NO_MATCH").when(F.coalesce("copies", F.lit(0)) != 1, "OTHER").when(t("reply").isNotNull(), F.lit(None))
        .when((t("skipped_same") == 0) & (t("blank_after") > 0), "TRANSCRIPT_ONLY_AFTER_TARGET").when(t("skipped_same") > 0, "NO_DIFFERENT_SPEAKER_RESPONSE").otherwise("SCENE_END")
    )
    ok = reason.isNull()
    reply = lambda f: F.when(ok, F.col(f"t.reply.{f}"))
    found = out.select(*alignment.columns, reason.alias("drop_reason"), reply("utterance_id").alias("response_id"), reply("speaker").alias("response_speaker"), F.when(ok, F.col("t.reply.position") - t("position")).alias("distance"), F.when(ok, t("skipped_same")).alias("skipped_same_speaker"), F.when(ok, t("conversation_id")).alias("__scene"), reply("position").alias("__position"))
    if not text:
        return found.drop("__scene", "__position")
    texts = scene_positions(corpus.select("conversation_id", "order", "text")).select(F.col("conversation_id").alias("__scene"), F.col("position").alias("__position"), F.col("text").alias("response_text"))
    return found.join(texts, ["__scene", "__position"], "left").select(*alignment.columns, "drop_reason", "response_id", "response_text", "response_speaker", "distance", "skipped_same_speaker")


def split_replies(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): the rows with a reply, and those with a reason why there is none. replies: a written table, read by both."""
    return replies.filter("drop_reason is null"), replies.filter("drop_reason is not null")


def reply_violations(replies: DataFrame, corpus: DataFrame) -> DataFrame:
    """rule, violations of (utterance_id, response_id, target_text) against the corpus: both are looked up by their ids."""
    row = lambda of: F.struct("conversation_id", "order", "speaker", "text", "text_norm").alias(of)
    target, reply = corpus.select("utterance_id", row("t")), corpus.select(F.col("utterance_id").alias("response_id"), row("r"))
    met = replies.join(target, "utterance_id", "left").join(reply, "response_id", "left")
    return violations(
        met, ids_known=F.col("t").isNotNull() & F.col("r").isNotNull(), same_scene=F.col("t.conversation_id") == F.col("r.conversation_id"), reply_is_later=F.col("r.order") > F.col("t.order"), other_speaker=F.col("r.speaker") != F.col("t.speaker"),
        reply_has_words=F.col("r.text_norm") != "", reply_is_no_note=F.col("r.speaker") != "TRANSCRIPT_NOTE", target_unchanged=F.col("target_text").eqNullSafe(F.col("t.text")),
    )


def aliases(aliases: DataFrame, corpus: DataFrame, targets: DataFrame) -> DataFrame:
    """alias, name of the targets' speakers: those of the given pairs of which both names were observed; the others have a null name."""
    names = corpus.select(F.col("speaker").alias("name")).distinct()
    held = aliases.select("alias", "name").join(names, "name", "left_semi")
    return targets.select(F.col("speaker").alias("alias")).distinct().join(held, "alias", "left").select("alias", "name")


def renamed(targets: DataFrame, names: DataFrame) -> DataFrame:
    """targets with the corpus' names of their speakers and of those of their context; null where there is none. names has one row a speaker, so it is one map for all rows."""
    table = names.filter("name is not null").agg(F.map_from_entries(F.collect_set(F.struct("alias", "name"))).alias("__names"))
    named = targets.join(F.broadcast(table))
    of = lambda who: F.try_element_at("__names", F.coalesce(who, F.lit("")))
    return named.withColumns({"speaker": of(F.col("speaker")), "context_speakers": F.transform("context_speakers", of)}).drop("__names")


def alignment_report(replies: DataFrame, known_episodes: DataFrame) -> DataFrame:
    """One row: counts and rates of the levels, recovered replies, coverage and concentration of scenes, episodes and speakers, and the verdict.

    replies: an alignment with its replies, scene and episode (a written table). known_episodes: one row.
    """
    kept = replies.filter("drop_reason is null")
    share = lambda name: concentration(kept, name).select(F.coalesce(F.max("largest_share"), F.lit(0.0)).alias(f"{name}_share"), F.coalesce(F.max("groups"), F.lit(0)).alias(f"{name}s"))
    level = F.col("alignment_type")
    counts = replies.agg(F.count(F.lit(1)).alias("targets"), *(F.count_if(level == LEVELS[k]).alias(n) for k, n in (("exact", "exact"), ("high", "high"), ("ambiguous", "ambiguous"), ("none", "unmatched"))), F.count_if(F.col("drop_reason").isNull()).alias("retained"))
    whole = counts.join(share("scene")).join(share("episode")).join(share("response_speaker")).join(known_episodes)  # one row each
    rate = F.coalesce(F.try_divide("ambiguous", "targets"), F.lit(0.0))
    verdict = feasibility(F.col("retained"), F.col("episodes"), F.col("episode_share"), F.col("response_speaker_share"), rate)
    found = F.col("targets") - F.col("unmatched")
    rates = {"exact_rate": ("exact", F.col("targets")), "high_rate": ("high", F.col("targets")), "recovery_rate": ("retained", found), "episode_coverage": ("episodes", F.col("known_episodes"))}
    return whole.select("*", *(percent(F.col(n), of).alias(k) for k, (n, of) in rates.items()), verdict.alias("verdict"))


def feasibility(retained: Column, episodes: Column, episode_share: Column, speaker_share: Column, ambiguity: Column) -> Column:
    # fixed values: limits of each verdict
    bad = (retained < 80) | (episodes < 10) | (episode_share > 0.2) | (speaker_share > 0.75) | (ambiguity > 0.5)
    strong = (retained >= 200) & (episodes >= 30) & (episode_share <= 0.1) & (speaker_share <= 0.6)
    moderate = (retained >= 150) & (episodes >= 20) & (episode_share <= 0.15) & (speaker_share <= 0.7)
    return F.when(bad, "NOT_RECOMMENDED").when(strong, "STRONG").when(moderate, "MODERATE").otherwise("WEAK")
