"""From candidate scores to decisions, paired metrics and cluster-bootstrap intervals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.sources.storage import numbered, written

GROUP = ("method", "fold", "seed", "sample_id")
# Names of the recognition groups and response transitions.
RECOGNITION = ("corrected", "corrupted", "stable-correct", "stable-wrong")
RESPONSE = ("helpful", "harmful", "stable-correct", "stable-wrong")


def decisions(scores: DataFrame, *keys: str, ties: str = "position") -> DataFrame:
    """Per group of candidates whether the best-scored is the reply. Ties: the first position, or the smallest id."""
    keys = keys or (*GROUP, "condition")
    last = F.struct("selector_logit", -F.col("candidate_pos"))
    if ties == "id":
        top = F.min_by("is_gold", F.struct(-F.col("selector_logit"), "candidate_id"))
    else:
        top = F.max_by("is_gold", last)
    return scores.groupBy(*keys).agg(top.cast("int").alias("correct"))


def incomplete_groups(scores: DataFrame, candidates: int = 4) -> DataFrame:
    """Groups that do not have the wanted number of rows, one reply, finite scores and different candidates."""
    finite = F.count_if(F.col("selector_logit").isNull() | F.isnan("selector_logit") | (F.abs("selector_logit") == float("inf")))
    seen = scores.groupBy(*GROUP, "condition").agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_gold").alias("gold"), finite.alias("not_finite"), F.count_distinct("candidate_id").alias("ids"))
    return seen.filter(f"rows <> {candidates} or ids <> {candidates} or gold <> 1 or not_finite > 0")


def score_mismatches(scores: DataFrame, tasks: DataFrame) -> DataFrame:
    """problem, n of scored groups against the candidates of their tasks, in order: groups without a task, tasks that some run lacks, groups with other candidates.

    scores: GROUP, condition, candidate_pos, candidate_id. tasks: fold, sample_id, candidate_pos, candidate_id.
    """
    listed = lambda df, *keys: df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("candidate_pos", "candidate_id"))).alias("held"))
    runs = scores.select("method", "seed", "condition").distinct()  # one row a run
    wanted = listed(tasks, "fold", "sample_id").withColumnRenamed("held", "wanted").join(F.broadcast(runs))
    met = listed(scores, *GROUP, "condition").join(wanted, [*GROUP, "condition"], "full")
    counts = met.agg(F.count_if(F.col("wanted").isNull()).alias("no_task"), F.count_if(F.col("held").isNull()).alias("not_scored"), F.count_if(F.col("held") != F.col("wanted")).alias("other_candidates"))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("problem"), F.col(c).alias("n")) for c in counts.columns))).alias("p")).select("p.*")


def identity_mismatches(scores: DataFrame, predictions: DataFrame) -> DataFrame:
    """column, n: targets of a run whose dialogue, episode or label differs between scores and recognition, or that recognition lacks."""
    keys, columns = ["method", "fold", "seed", "source_index"], {"dialogue_id": "dialogue_id", "episode_id": "episode_id", "target_label": "true_label"}
    one = scores.select(*keys, *columns).distinct().withColumn("__s", F.lit(True))
    met = one.join(predictions.select(*keys, *(F.col(p).alias(f"__{c}") for c, p in columns.items()), F.lit(True).alias("__p")), keys, "full")
    both = F.col("__s").isNotNull() & F.col("__p").isNotNull()
    counts = met.agg(F.count_if(F.col("__p").isNull()).alias("not_recognised"), *(F.count_if(both & ~F.col(c).eqNullSafe(F.col(f"__{c}"))).alias(c) for c in columns))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in counts.columns))).alias("p")).select("p.*")


def outcomes(scores: DataFrame, predictions: DataFrame) -> DataFrame:
    """Response decisions of both conditions next to the recognition of the same turn, with group and transition.

    A response without a recognition raises an error: both are made of the same observations.
    """
    best = lambda c: F.max_by("is_gold", F.when(F.col("condition") == c, F.struct("selector_logit", -F.col("candidate_pos")))).cast("int")
    keys = ("method", "fold", "seed", "source_index", "sample_id", "episode_id", "target_label")
    both = scores.groupBy(*keys).agg(best("text").alias("response_text_correct"), best("text_audio").alias("response_text_audio_correct"))
    known = predictions.select("method", "fold", "seed", "source_index", "true_label", "text_label", "text_audio_label", F.lit(True).alias("__known"))
    out = both.join(known, ["method", "fold", "seed", "source_index"], "left")
    lost = F.raise_error(F.concat(F.lit("no recognition of turn "), F.col("source_index").cast("string"))).cast("boolean")
    out = out.filter(F.when(F.col("__known").isNull(), lost).otherwise(True)).drop("__known")
    before, after = F.col("text_label") == F.col("true_label"), F.col("text_audio_label") == F.col("true_label")
    group = F.when(~before & after, "corrected").when(before & ~after, "corrupted").when(before, "stable-correct").otherwise("stable-wrong")
    a, b = F.col("response_text_correct") == 1, F.col("response_text_audio_correct") == 1
    move = F.when(~a & b, "helpful").when(a & ~b, "harmful").when(a, "stable-correct").otherwise("stable-wrong")
    return out.withColumns({"recognition_group": group, "response_transition": move})


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def binary_metrics(rows: DataFrame, true: str, predicted: str, *keys: str) -> DataFrame:
    """accuracy, balanced_accuracy (null unless both classes occur), f1 (0 if undefined), and the confusion counts."""
    t, p = F.col(true), F.col(predicted)
    cells = {"tp": (t == 1) & (p == 1), "fp": (t == 0) & (p == 1), "fn": (t == 1) & (p == 0), "tn": (t == 0) & (p == 0)}
    out = rows.groupBy(*keys).agg(*(F.count_if(c).alias(n) for n, c in cells.items()))
    tp, fp, fn, tn = (F.col(c) for c in cells)
    return out.withColumns({"accuracy": _ratio(tp + tn, tp + fp + fn + tn), "balanced_accuracy": (_ratio(tp, tp + fn) + _ratio(tn, tn + fp)) / 2, "f1": F.coalesce(_ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0))})


def paired_metrics(rows: DataFrame, *keys: str, sets: list[list[str]] | None = None) -> DataFrame:
    """All paired recognition and response metrics of outcome rows, from one aggregate. Undefined ones are null.

    sets: the sets of keys to group by, in one pass; keys that a set lacks are null in its rows. Without it, all keys.
    """
    true, text, audio = F.col("true_label"), F.col("text_label"), F.col("text_audio_label")
    a, b = F.col("response_text_correct"), F.col("response_text_audio_correct")
    corrected, literal, sarcastic = F.col("recognition_group") == "corrected", F.col("target_label") == 0, F.col("target_label") == 1
    n = lambda c: F.count_if(c)
    counts = {
        "observations": n(F.lit(True)), "positives": n(true == 1), "negatives": n(true == 0), "literal_n": n(literal), "sarcastic_n": n(sarcastic), "corrected_n": n(corrected),
        "helpful": n((b == 1) & (a == 0)), "harmful": n((b == 0) & (a == 1)), "helpful_corrected": n(corrected & (b == 1) & (a == 0)), "harmful_corrected": n(corrected & (b == 0) & (a == 1)),
        "recognition_helpful": n((text != true) & (audio == true)), "recognition_harmful": n((text == true) & (audio != true)),
        "text_right": F.sum(a), "audio_right": F.sum(b), "literal_net": F.sum(F.when(literal, b - a).otherwise(0)), "sarcastic_net": F.sum(F.when(sarcastic, b - a).otherwise(0)),
        **{f"{k}_{s}": n((true == t) & (p == q)) for k, p in (("text", text), ("text_audio", audio)) for s, t, q in (("tp", 1, 1), ("fn", 1, 0), ("fp", 0, 1), ("tn", 0, 0))},
    }
    grouped = rows.groupBy(*keys) if sets is None else rows.groupingSets([[F.col(k) for k in some] for some in sets], *map(F.col, keys))
    out = grouped.agg(*(c.alias(name) for name, c in counts.items()))
    c = F.col
    made = {}
    for k in ("text", "text_audio"):
        tp, fn, fp, tn = (c(f"{k}_{s}") for s in ("tp", "fn", "fp", "tn"))
        made |= {f"recognition_{k}_f1": F.coalesce(_ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0)), f"recognition_{k}_ba": (_ratio(tp, tp + fn) + _ratio(tn, tn + fp)) / 2, f"recognition_{k}_accuracy": _ratio(tp + tn, c("observations"))}
    out = out.withColumns(made).withColumns({"delta_literal": _ratio(c("literal_net"), c("literal_n")), "delta_sarcastic": _ratio(c("sarcastic_net"), c("sarcastic_n"))})
    return out.select(
        *keys, *made, (c("recognition_text_audio_ba") - c("recognition_text_ba")).alias("delta_recognition"), _ratio(c("text_right"), c("observations")).alias("response_text_accuracy"),
        _ratio(c("audio_right"), c("observations")).alias("response_text_audio_accuracy"), _ratio(c("audio_right") - c("text_right"), c("observations")).alias("delta_response"),
        "delta_literal", "delta_sarcastic", (c("delta_sarcastic") - c("delta_literal")).alias("did"), _ratio(c("helpful_corrected") - c("harmful_corrected"), c("corrected_n")).alias("delta_corrected"),
        "observations", "corrected_n", "helpful", "harmful", "helpful_corrected", "harmful_corrected", (c("corrected_n") - c("helpful_corrected") - c("harmful_corrected")).alias("unchanged_corrected"),
        "recognition_helpful", "recognition_harmful", (c("recognition_helpful") - c("recognition_harmful")).alias("recognition_net"), _ratio(c("helpful"), c("harmful")).alias("help_harm_ratio"),
        _ratio(c("helpful_corrected"), c("harmful_corrected")).alias("corrected_help_harm_ratio"), _ratio(c("helpful"), c("observations")).alias("oracle_route_gain"),
    )


def by_seed_and_pooled(rows: DataFrame) -> DataFrame:
    """paired_metrics per method and seed, and per method over all seeds (seed null)."""
    return paired_metrics(rows, "method", "seed", sets=[["method", "seed"], ["method"]])


def transitions(rows: DataFrame) -> DataFrame:
    """The 4 x 4 table of recognition groups and response transitions per method, zeros included."""
    grid = rows.select("method").distinct().withColumn("recognition_group", F.explode(F.array(*map(F.lit, RECOGNITION)))).withColumn("response_transition", F.explode(F.array(*map(F.lit, RESPONSE))))
    seen = rows.groupBy("method", "recognition_group", "response_transition").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(seen, ["method", "recognition_group", "response_transition"], "left").fillna(0, ["n"])


#: Sums per method and episode that the bootstrap's quantities are made of.
SUMS = ("positives", "negatives", "text_tp", "text_tn", "audio_tp", "audio_tn", "literal", "sarcastic", "corrected", "literal_net", "sarcastic_net", "corrected_net")


def episode_statistics(rows: DataFrame, episodes: DataFrame) -> DataFrame:
    """SUMS per method and episode: confusion counts of both recognisers, and per label and for corrected turns how many responses there are and by how many right ones audio is ahead. Episodes without rows have zeros."""
    true, a, b = F.col("true_label"), F.col("response_text_correct"), F.col("response_text_audio_correct")
    parts = {"literal": F.col("target_label") == 0, "sarcastic": F.col("target_label") == 1, "corrected": F.col("recognition_group") == "corrected"}
    counts = {
        "positives": true == 1, "negatives": true == 0, "text_tp": (true == 1) & (F.col("text_label") == 1), "text_tn": (true == 0) & (F.col("text_label") == 0),
        "audio_tp": (true == 1) & (F.col("text_audio_label") == 1), "audio_tn": (true == 0) & (F.col("text_audio_label") == 0), **parts,
    }
    seen = rows.groupBy("method", "episode_id").agg(*(F.count_if(c).alias(n) for n, c in counts.items()), *(F.sum(F.when(c, b - a).otherwise(0)).alias(f"{n}_net") for n, c in parts.items()))
    grid = episodes.select("episode_id").distinct().join(rows.select("method").distinct())
    return grid.join(seen, ["method", "episode_id"], "left").fillna(0).select("method", "episode_id", *SUMS)


#: Replicates whose weights stand in one array, and clusters that one task counts draws for.
REPLICATES, CLUSTERS = 100, 40_000


def drawn(replicate: np.ndarray, draws: np.ndarray, clusters: int) -> np.ndarray:
    """(replicates x draws) numbers of clusters: a 64-bit mix (splitmix) of replicate and draw, modulo the clusters."""
    z = ((replicate.astype(np.uint64)[:, None] << np.uint64(32)) + draws.astype(np.uint64)[None, :] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) % np.uint64(clusters)).astype(np.int64)


def resample_weights(spark: SparkSession, clusters: int, resamples: int) -> DataFrame:
    """number, block, weights: how often each cluster is drawn, with replacement, in each replicate of a block of REPLICATES.

    A replicate draws as many clusters as there are. Draws are made and counted within tasks, per block and range of
    CLUSTERS, so no draw is a row.
    """
    blocks, ranges = -(-resamples // REPLICATES), -(-clusters // CLUSTERS)

    def count(batches):
        for batch in batches:
            for task in batch.column("id").to_pylist():
                block, lo = task // ranges, task % ranges * CLUSTERS
                hi = min(clusters, lo + CLUSTERS)
                replicates = np.arange(block * REPLICATES, min(resamples, (block + 1) * REPLICATES))
                total = np.zeros((len(replicates), hi - lo), np.int64)
                for x in range(0, clusters, 10_000):
                    number = drawn(replicates, np.arange(x, min(clusters, x + 10_000)), clusters) - lo
                    mine = (number >= 0) & (number < hi - lo)
                    place = (np.arange(len(replicates))[:, None] * (hi - lo) + number)[mine]
                    total += np.bincount(place, minlength=total.size).reshape(total.shape)
                for x in range(lo, hi, 1000):
                    y = min(hi, x + 1000)
                    flat = pa.array(total[:, x - lo : y - lo].T.reshape(-1).astype(np.int32))
                    cuts = pa.array(np.arange(y - x + 1, dtype=np.int32) * len(replicates))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(x, y)), pa.array(np.full(y - x, block)), pa.ListArray.from_arrays(cuts, flat)], ["number", "block", "weights"])

    return spark.range(0, blocks * ranges, 1, min(blocks * ranges, 1000)).mapInArrow(count, "number long, block long, weights array<int>")


def bootstrap(statistics: DataFrame, resamples: int = 2000) -> DataFrame:
    """Percentile intervals of the six paired quantities over draws of episodes with replacement. One row per method and metric.

    statistics: the rows of episode_statistics. Draws are the same for all methods. Only sums per episode are resampled,
    never rows: an episode's sums meet its weights once per block, and tasks multiply both as matrices, so one vector of a task, method
    and block is added up.
    Undefined draws are left out and counted; bounds are null if all are undefined.
    """
    spark = statistics.sparkSession
    stats = written(statistics, "episode-sums")
    episodes = numbered(stats.select("episode_id").distinct(), "episode_id", "number")
    n = episodes.count()
    if n < 2:
        raise ValueError("a cluster bootstrap takes two episodes or more")
    weights = resample_weights(spark, n, resamples)
    met = stats.join(episodes, "episode_id").join(weights, "number").select("method", "block", "weights", F.array(*(F.col(c).cast("double") for c in SUMS)).alias("sums"))

    def products(batches):
        total: dict[tuple[str, int], np.ndarray] = {}  # sums x replicates of a block
        for batch in batches:
            method, block = batch.column("method").to_pylist(), batch.column("block").to_numpy()
            held, drawn = batch.column("sums").flatten().to_numpy().reshape(-1, len(SUMS)), batch.column("weights")
            for key in set(zip(method, block.tolist())):
                mine = np.array([m == key[0] for m in method], bool) & (block == key[1])
                w = drawn.filter(pa.array(mine)).flatten().to_numpy().reshape(int(mine.sum()), -1).astype(np.float64)
                total[key] = total.get(key, 0) + held[mine].T @ w
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in total]), pa.array([k for _, k in total], pa.int64()), pa.array([v.shape[1] for v in total.values()], pa.int32()), pa.array([v.reshape(-1).tolist() for v in total.values()], pa.list_(pa.float64()))], ["method", "block", "held", "v"])

    total = met.mapInArrow(products, "method string, block long, held int, v array<double>").withColumn("v", array_to_vector("v"))
    total = total.groupBy("method", "block", "held").agg(Summarizer.sum(F.col("v")).alias("v")).withColumn("v", vector_to_array("v"))
    at = total.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("held") - 1)))
    sums = at.select("method", *(F.get("v", F.col("r") + F.col("held") * k).alias(c) for k, c in enumerate(SUMS)))  # one row per method and replicate
    c = F.col
    ba = lambda k: (_ratio(c(f"{k}_tp"), c("positives")) + _ratio(c(f"{k}_tn"), c("negatives"))) / 2
    literal, sarcastic = _ratio(c("literal_net"), c("literal")), _ratio(c("sarcastic_net"), c("sarcastic"))
    metrics = {
        "delta_recognition": ba("audio") - ba("text"), "delta_literal": literal, "delta_sarcastic": sarcastic, "delta_response": _ratio(c("literal_net") + c("sarcastic_net"), c("literal") + c("sarcastic")),
        "did": sarcastic - literal, "delta_corrected": _ratio(c("corrected_net"), c("corrected")),
    }
    long = sums.select("method", F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in metrics.items()))).alias("m")).select("method", "m.metric", "m.value")
    return long.groupBy("method", "metric").agg(F.percentile("value", 0.025).alias("low"), F.percentile("value", 0.975).alias("high"), F.count("value").alias("valid"), F.count_if(F.col("value").isNull()).alias("undefined"))


def cross_entropy(rows: DataFrame, logit: Column, label: Column, positive_weight: float, *keys: str) -> DataFrame:
    """Weighted binary cross-entropy from logits, in a form that does not overflow."""
    tail = F.log1p(F.exp(-F.abs(logit)))
    loss = positive_weight * label * (tail + F.greatest(-logit, F.lit(0.0))) + (1 - label) * (tail + F.greatest(logit, F.lit(0.0)))
    return rows.groupBy(*keys).agg(F.avg(loss).alias("loss"))


def sequence_scores(rows: DataFrame, logprobs: str = "logprobs") -> DataFrame:
    """total, mean and n of a candidate's token log-probabilities; a value that is not finite raises an error."""
    bad = F.exists(logprobs, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    total = F.when(bad, F.raise_error(F.lit("a log-probability is not finite")).cast("double")).otherwise(F.aggregate(logprobs, F.lit(0.0), lambda a, x: a + x))
    return rows.withColumn("total", total).withColumn("n", F.size(logprobs)).withColumn("mean", _ratio(F.col("total"), F.col("n")))
