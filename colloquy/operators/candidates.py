"""Constrained multiple-choice candidates and the selection of evaluation and training targets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.hashing import bucket, stable_hex, stable_int
from colloquy.functions.text import CONDITIONS, prompt, token_count, turn_line
from colloquy.sources.storage import written

SALT = "colloquy-v1"


#: Difference of lengths within which distractors are looked for first, and what it is multiplied by for those that find too few.
NEAR, WIDER = 16, 4


def _slim(records: DataFrame, *keys: str) -> DataFrame:
    return records.select("source_index", "dialogue_id", "target_label", *keys, F.length("response").alias("size"), F.sha2("response", 256).alias("said"))


def _other(slim: DataFrame, *keys: str) -> DataFrame:
    return slim.select(*keys, *(F.col(c).alias(f"o_{c}") for c in ("source_index", "dialogue_id", "target_label", "size", "said")))


def distractor_pool(asked: DataFrame, slim: DataFrame, keys: list[str], within: int, salt: str = SALT) -> DataFrame:
    """(target, source) pairs: equal keys (episode, next speaker, …), the wanted label, other dialogue, other response, and lengths that differ by no more than within.

    asked: rows of _slim with same (whether the label wanted is the target's). Only ids, lengths and hashes are joined, on
    cells of lengths too.
    """
    label = F.when(F.col("same"), F.col("target_label")).otherwise(1 - F.col("target_label"))
    cells = asked.withColumns({"o_target_label": label, "__cell": F.explode(F.sequence(F.floor((F.col("size") - within) / within), F.floor((F.col("size") + within) / within)))})
    pairs = cells.join(_other(slim, *keys).withColumn("__cell", F.floor(F.col("o_size") / within)), [*keys, "o_target_label", "__cell"])
    pairs = pairs.filter((F.abs(F.col("size") - F.col("o_size")) <= within) & (F.col("dialogue_id") != F.col("o_dialogue_id")) & (F.col("said") != F.col("o_said")))
    rank = F.struct(F.abs(F.col("size") - F.col("o_size")).alias("gap"), stable_hex(F.concat_ws("|", "source_index", "o_source_index"), salt).alias("hash"))
    return pairs.select("source_index", "dialogue_id", "target_label", F.col("o_source_index").alias("pool_index"), "same", F.col("o_said").alias("said"), rank.alias("rank"))


def nearest_texts(records: DataFrame, salt: str = SALT, *also: str, sizes: DataFrame | None = None) -> DataFrame:
    """source_index, dialogue_id, target_label, same, said, b (rank, pool_index), n: of each target's pool, per same, the first three different texts by rank.

    Ranks begin with the difference of lengths. So neighbours in length are looked for outward, in rings that grow until
    a target has found three different texts of a kind, or as many as its pool holds (sizes: the rows of pool_sizes). No
    target meets its whole group, unless the group is that narrow: among rows of equal lengths, ranks are hashes of both
    rows, so all of them have to be compared.
    """
    keys = ["episode_id", "next_speaker", *also]
    slim = written(_slim(records, *keys), "distractor-rows")
    wanted = (pool_sizes(records, *also) if sizes is None else sizes).select("source_index", "same", F.least("texts", F.lit(3)).alias("wanted")).filter("wanted > 0")
    asked, within, done = written(slim.join(wanted, "source_index"), "asked"), NEAR, []
    while True:
        best = distractor_pool(asked, slim, keys, within, salt).groupBy("source_index", "dialogue_id", "target_label", "same", "said").agg(F.min(F.struct("rank", "pool_index")).alias("b"))
        first = best.withColumn("n", F.row_number().over(Window.partitionBy("source_index", "same").orderBy("b"))).filter("n <= 3")
        met = written(first.join(asked.select("source_index", "same", "wanted"), ["source_index", "same"]), "near-distractors")
        enough = met.filter("n = wanted").select("source_index", "same")
        done.append(met.join(enough, ["source_index", "same"], "left_semi").select("source_index", "dialogue_id", "target_label", "same", "said", "b", "n"))
        rest = written(asked.join(enough, ["source_index", "same"], "left_anti"), "asked")
        if not rest.limit(1).count():
            return reduce(DataFrame.unionByName, done)
        asked, within = rest, within * WIDER


def pool_sizes(records: DataFrame, *also: str) -> DataFrame:
    """source_index, same, pool, texts: rows and different texts of each target's pool of either label, from counts of the group.

    Rows of the own dialogue and rows with the own text don't belong to a pool; those that are both are taken off once.
    """
    keys = ["episode_id", "next_speaker", *also]
    slim = _slim(records, *keys)
    by_text = slim.groupBy(*keys, F.col("target_label").alias("label"), "said").agg(F.count(F.lit(1)).alias("k"), F.min("dialogue_id").alias("lo"), F.max("dialogue_id").alias("hi"))
    groups = by_text.groupBy(*keys, "label").agg(F.sum("k").alias("rows"), F.count(F.lit(1)).alias("all_texts"))
    own = slim.groupBy(*keys, F.col("target_label").alias("label"), "dialogue_id").agg(F.count(F.lit(1)).alias("own_rows"))
    alone = by_text.filter("lo = hi").groupBy(*keys, "label", F.col("lo").alias("dialogue_id")).agg(F.count(F.lit(1)).alias("own_texts"))
    both = slim.groupBy(*keys, F.col("target_label").alias("label"), "dialogue_id", "said").agg(F.count(F.lit(1)).alias("both_rows"))
    met = slim.drop("size").join(groups, keys).join(own, [*keys, "label", "dialogue_id"], "left").join(alone, [*keys, "label", "dialogue_id"], "left")
    met = met.join(by_text.select(*keys, "label", "said", F.col("k").alias("same_text")), [*keys, "label", "said"], "left").join(both, [*keys, "label", "dialogue_id", "said"], "left")
    c = lambda name: F.coalesce(name, F.lit(0))
    elsewhere = (c("same_text") > c("both_rows")).cast("long")
    out = met.select("source_index", (F.col("label") == F.col("target_label")).alias("same"), (F.col("rows") - c("own_rows") - c("same_text") + c("both_rows")).alias("pool"), (F.col("all_texts") - c("own_texts") - elsewhere).alias("texts"))
    return out.filter("pool > 0")


def candidate_sets(records: DataFrame, salt: str = SALT, *also: str) -> DataFrame:
    """Four candidates a target, in hash order: the reply, the best of the same and of the other label, and a third.

    A hash of dialogue and label says which label the third has; it is the best there with a text of its own. Targets
    without four different texts have no candidates. One row per candidate: source_index, candidate_pos, candidate_id,
    is_gold, candidate_source_index, candidate_source_dialogue_id, candidate_source_label, candidate_text.
    """
    # several steps read the records, which come from windows over all turns: without contexts they are written once
    needed = ("source_index", "dialogue_id", "episode_id", "next_speaker", "target_label", "response", *also)
    records = written(records.select(*needed), "candidate-records")
    # the third choice avoids two texts at most
    sets = nearest_texts(records, salt, *also).groupBy("source_index", "dialogue_id", "target_label").agg(
        F.min_by(F.struct("said", "b.pool_index"), F.when(F.col("same"), F.col("b"))).alias("like"),
        F.min_by(F.struct("said", "b.pool_index"), F.when(~F.col("same"), F.col("b"))).alias("unlike"),
        F.array_sort(F.collect_list(F.struct("b", "same", "said"))).alias("all"),
    )
    parity = stable_int(F.concat_ws("|", "dialogue_id", "target_label", F.lit("third")), salt) % 2 == 0
    third = F.get(F.filter("all", lambda c: (c["same"] == parity) & (c["said"] != F.col("like.said")) & (c["said"] != F.col("unlike.said"))), F.lit(0))
    sets = sets.filter("like is not null and unlike is not null and like.said <> unlike.said").withColumn("third", third).filter("third is not null")
    chosen = F.array(F.struct(F.lit("gold").alias("id"), F.col("source_index").alias("at")), *(F.struct(F.lit(f"distractor-{i + 1}").alias("id"), x.alias("at")) for i, x in enumerate((F.col("like.pool_index"), F.col("unlike.pool_index"), F.col("third.b.pool_index")))))
    rows = sets.select("source_index", F.explode(chosen).alias("c")).select("source_index", F.col("c.id").alias("candidate_id"), F.col("c.at").alias("at"))
    texts = records.select(F.col("source_index").alias("at"), F.col("response").alias("candidate_text"), F.col("dialogue_id").alias("candidate_source_dialogue_id"), F.col("target_label").alias("candidate_source_label"))
    rows = rows.join(texts, "at").withColumn("__h", stable_hex(F.concat_ws("|", "source_index", "candidate_id", "candidate_text"), salt))
    place = F.row_number().over(Window.partitionBy("source_index").orderBy("__h")) - 1
    return rows.select("source_index", place.alias("candidate_pos"), "candidate_id", (F.col("candidate_id") == "gold").alias("is_gold"), (F.col("at") + 1).alias("candidate_source_index"), "candidate_source_dialogue_id", "candidate_source_label", "candidate_text")


def token_budget(examples: DataFrame, candidates: DataFrame, budget: int, conditions: tuple[str, ...] = CONDITIONS, counter=token_count) -> DataFrame:
    """Drop a target's oldest turns until its prompts, under every condition and with every candidate, fit the budget; at least one turn stays.

    examples: source_index, context_turns, next_speaker, predicted, target_label. Adds turns_dropped and fits. The
    counter must add up over the lines of a prompt (no token crosses a line end): each turn is counted once, the lines
    around the turns once per condition, and what a suffix holds is a running sum. A target without turns, or
    with a null candidate, fits nothing.
    """
    longest = candidates.groupBy("source_index").agg(F.max(counter(F.trim("candidate_text"))).alias("longest"))
    out = examples.join(longest, "source_index")
    bare = F.slice("context_turns", 1, 0)
    around = [counter(prompt(bare, F.col("next_speaker"), F.lit(c), F.col("predicted"), F.col("target_label"))) for c in conditions]
    # tokens of a turn's line; a turn with a null part has no line
    out = out.withColumn("__sizes", F.transform("context_turns", lambda t: F.coalesce(counter(turn_line(t)), F.lit(0)).cast("long")))
    # one pass from the last turn backwards: tokens so far, and turns that fit; what stands around the turns is where it
    # starts, so it is counted once and not in every step
    fixed = F.col("longest") + (F.greatest(*around) if len(around) > 1 else around[0])
    start = F.struct(fixed.cast("long").alias("held"), F.lit(0).alias("kept"), F.lit(True).alias("going"))

    def step(x: Column, n: Column) -> Column:
        going = x["going"] & F.coalesce(x["held"] + n <= budget, F.lit(False))
        return F.struct((x["held"] + n).alias("held"), (x["kept"] + going.cast("int")).alias("kept"), going.alias("going"))

    kept = F.aggregate(F.reverse("__sizes"), start, step, lambda x: x["kept"])
    out = out.withColumn("__kept", F.coalesce(kept, F.lit(0)))
    out = out.withColumn("fits", F.col("__kept") > 0).withColumn("turns_dropped", F.greatest(F.size("context_turns") - F.greatest("__kept", F.lit(1)), F.lit(0)))
    return out.withColumn("context_turns", F.slice("context_turns", F.col("turns_dropped") + 1, F.size("context_turns"))).drop("longest", "__sizes", "__kept")


def hash_order(salt: str = SALT) -> Column:
    return stable_hex(F.col("source_index"), salt)


def evaluation_pairs(records: DataFrame, valid: DataFrame, pairs: int, salt: str = SALT, required: bool = False) -> DataFrame:
    """The first dialogues in hash order that have, for both labels, a target among valid; per label the first target.

    Only the last step is ordered over all dialogues, as a top-k. required: fewer than ``pairs`` raise an error.
    """
    w = Window.partitionBy("dialogue_id", "target_label").orderBy(hash_order(salt))
    first = records.join(valid.select("source_index").distinct(), "source_index", "left_semi").withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
    both = first.groupBy("dialogue_id").agg(F.count_distinct("target_label").alias("labels")).filter("labels = 2")
    chosen = both.select("dialogue_id", stable_hex(F.col("dialogue_id"), salt).alias("__h")).orderBy("__h").limit(pairs)
    if required and (found := chosen.count()) < pairs:
        raise ValueError(f"{found} of {pairs} dialogue pairs")
    return first.join(chosen.select("dialogue_id"), "dialogue_id", "left_semi")


def training_targets(records: DataFrame, valid: DataFrame, per_label: int, salt: str) -> DataFrame:
    """The first valid targets of each label in hash order."""
    w = Window.partitionBy("target_label").orderBy(hash_order(salt))
    known = records.join(valid.select("source_index").distinct(), "source_index", "left_semi")
    return known.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_label)


def first_dialogues(records: DataFrame, number: int) -> DataFrame:
    """Records of the first dialogues in order of appearance."""
    first = records.groupBy("dialogue_id").agg(F.min("source_index").alias("at")).orderBy("at").limit(number)
    return records.join(first.select("dialogue_id"), "dialogue_id", "left_semi")


def rejections(records: DataFrame, candidates: DataFrame, budgeted: DataFrame) -> DataFrame:
    """Targets by reason of rejection, counted over all targets: no_candidate_set, token_budget, accepted."""
    known = candidates.select("source_index").distinct().withColumn("has", F.lit(True))
    out = records.select("source_index").join(known, "source_index", "left").join(budgeted.select("source_index", "fits"), "source_index", "left")
    reason = F.when(F.col("has").isNull(), "no_candidate_set").when(~F.col("fits"), "token_budget").otherwise("accepted")
    return out.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def with_fold(records: DataFrame, folds: int = 4, salt: str = SALT, unit: str = "episode_id") -> DataFrame:
    return records.withColumn("fold", bucket(F.col(unit), salt, folds))


def with_fold_map(records: DataFrame, folds: DataFrame) -> DataFrame:
    """Folds by an explicit (episode_id, fold) map; an episode without one raises an error."""
    out = records.join(folds, "episode_id", "left")
    return out.withColumn("fold", F.coalesce("fold", F.raise_error(F.concat(F.lit("no fold for "), "episode_id")).cast("int")))
