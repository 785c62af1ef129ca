"""Accounting and integrity checks. Each folds its rules into one aggregate over the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from colloquy.sources.storage import written


def value_counts(rows: DataFrame, *columns: str) -> DataFrame:
    """column, value, n for each of the columns, from one pass."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.column", "p.value").agg(F.count(F.lit(1)).alias("n"))


def array_lengths(rows: DataFrame, column: str) -> DataFrame:
    n = F.greatest(F.coalesce(F.size(column), F.lit(0)), F.lit(0))
    return rows.agg(F.min(n).alias("least"), F.max(n).alias("most"), F.avg(n).alias("mean"), F.percentile(n, 0.5).alias("median"))


def missing(rows: DataFrame, *columns: str) -> DataFrame:
    """field, missing: rows where it is null or ''."""
    counts = rows.agg(*(F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(c) for c in columns))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("missing")) for c in columns))).alias("f")).select("f.*")


def key_presence(rows: DataFrame, column: str) -> DataFrame:
    """key, n over a map column."""
    return rows.select(F.explode(F.map_keys(column)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def violations(rows: DataFrame, **rules: Column) -> DataFrame:
    """rule, violations: rows where a rule does not hold (null counts as a violation)."""
    counts = rows.agg(*(F.count_if(~F.coalesce(r, F.lit(False))).alias(n) for n, r in rules.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules))).alias("v")).select("v.*")


def audited(rows: DataFrame, name: str, keep: list[str] | None = None, **rules: Column) -> tuple[DataFrame, DataFrame]:
    """(rows as a written table, rule and violations over it). The write itself counts: the table is worked out and passed once.

    keep: the columns to write, if the rules need more than these. The counts are of the write's last stage, where Spark
    adds each partition once, however often its task runs. ``checked`` is the number of rows.
    """
    seen = Observation(name)
    counts = [F.count_if(~F.coalesce(r, F.lit(False))).alias(n) for n, r in rules.items()]
    watched = rows.observe(seen, F.count(F.lit(1)).alias("checked"), *counts)
    held = written(watched.select(*keep) if keep else watched, name)
    found = seen.get
    return held, rows.sparkSession.createDataFrame([(n, int(found[n])) for n in ("checked", *rules)], "rule string, violations long")


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """only_left, only_right, both, of the distinct keys of two tables."""
    tagged = left.select(key).distinct().withColumn("side", F.lit(1)).unionByName(right.select(key).distinct().withColumn("side", F.lit(2)))
    per = tagged.groupBy(key).agg(F.sum("side").alias("s"))
    return per.agg(F.count_if(F.col("s") == 1).alias("only_left"), F.count_if(F.col("s") == 2).alias("only_right"), F.count_if(F.col("s") == 3).alias("both"))


def accounting(source: DataFrame, accepted: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """Counts that show whether accepted and rejected rows make up the source, once each."""
    tagged = source.select(key, F.lit("s").alias("t")).unionByName(accepted.select(key, F.lit("a").alias("t"))).unionByName(rejected.select(key, F.lit("r").alias("t")))
    per = tagged.groupBy(key).agg(*(F.count_if(F.col("t") == t).alias(t) for t in "sar"))
    return per.agg(F.sum("s").alias("source"), F.sum("a").alias("accepted"), F.sum("r").alias("rejected"), F.count_if((F.col("a") + F.col("r")) != F.col("s")).alias("unbalanced"), F.count_if((F.col("a") > 0) & (F.col("r") > 0)).alias("in_both"), F.count_if(F.col("s") > 1).alias("repeated"))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def concentration(rows: DataFrame, *columns: str) -> DataFrame:
    """column, groups, largest_share."""
    counts = value_counts(rows, *columns)
    return counts.groupBy("column").agg(F.count(F.lit(1)).alias("groups"), (F.max("n") / F.sum("n")).alias("largest_share"))


def tag_counts(rows: DataFrame, column: str) -> DataFrame:
    tag = F.explode(F.split(column, ";")).alias("tag")
    return rows.select(tag).filter("tag <> ''").groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag")


def disagreements(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """column, differ of two tables over their common keys, null-safely, and the keys that only one of them has."""
    other = right.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns), F.lit(True).alias("__there"))
    met = left.join(other, keys, "full")
    return met.agg(F.count(F.lit(1)).alias("keys"), *(F.count_if(~F.col(c).eqNullSafe(F.col(f"__{c}"))).alias(f"{c}_differs") for c in columns))


def one_spelling(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Rows whose column is name in any case; an error unless they all spell it the same way."""
    met = rows.filter(F.lower(column) == name.lower())
    spelled = met.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))  # one row
    wrong = F.raise_error(F.lit(f"{name} is spelled in several ways")).cast("boolean")
    return met.join(F.broadcast(spelled)).filter(F.when(F.col("__lo") == F.col("__hi"), True).otherwise(wrong)).drop("__lo", "__hi")


def run_violations(runs: DataFrame, expected: DataFrame, seeds: list[int], training: int | Column) -> DataFrame:
    """rule, violations of run summaries (method, fold, status, overlap, seeds, training_targets, evaluation_targets, score_rows array per seed, config) against (fold, targets).

    Score files hold targets x 4 candidates x 2 conditions; all runs of a method share one configuration.
    """
    drift = runs.groupBy("method").agg((F.count_distinct("config") == 1).alias("one_config"))  # one row a method
    met = runs.join(expected, "fold", "left").join(F.broadcast(drift), "method")
    return violations(
        met, complete=F.col("status") == "complete", no_overlap=~F.col("overlap"), all_seeds=F.col("seeds") == F.array(*map(F.lit, seeds)), training_targets=F.col("training_targets") == training,
        evaluation_targets=F.col("evaluation_targets") == F.col("targets"), score_rows=(F.size("score_rows") == len(seeds)) & F.forall("score_rows", lambda n: n == F.col("targets") * 8), one_config=F.col("one_config"),
    )
