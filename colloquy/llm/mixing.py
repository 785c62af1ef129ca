"""Mixing sources to target weights, with DataFrame functions only.

1. Targets: the words of all sources are shared out by weight; no source gets more than ``max_repeat`` times its own
   words, and what it can't take goes to the others by weight. Sources in order of (limit / weight) make this a
   running sum: the first ones are at their limit, the rest get weight times one rate.
2. Packing: the documents of a source are laid end to end and cut into blocks of ``block_words`` words.
3. Slots: a source with target t reads all its blocks floor(t / size) times, and then blocks until t is reached; the
   last slot takes only the words that are still due. Slot i of a pass reads block P(i), P a keyed permutation of the
   source's full blocks (its short last block comes last in each pass).
4. Shards: every slot of an output shard draws its source at the target weights, with replacement, so a shard's counts
   are a multinomial draw. Where a source has drawn more slots than its target in all, it gives up those in the last
   shards, and sources that have drawn too few get them: shards vary as draws do, yet each source meets its target.
   Within a shard, a permutation of its places mixes the sources.
5. Blocks join slots on (source, block). The words taken of a document are those of its pieces in the mix.

Permutations are keyed Feistel networks over mixed-radix numbers with cycle walking, written as columns: no index
table is sorted or stored, so the largest source costs no more per row than the others.

Defined cases: null and empty texts have size 0 and are taken 0 times. A null source is a source of its own, the last.
Rows that repeat are documents of their own. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import materialise, maybe_broadcast

BLOCK_WORDS = 64
SHARD_SLOTS = 1 << 14
MAX_REPEAT = 3
#: Steps of a cycle walk. Out of range are fewer than sqrt(n) of n numbers, so a walk of 32 steps happens in n ** -16 cases; it then fails, rather than lose a slot.
WALK_STEPS = 32
#: Slots that one row expands into.
CHUNK = 4096
#: Documents in a bucket of the running sums, on average, and shards in a group of theirs.
BUCKET_DOCS, SHARD_GROUP = 1000, 1024
#: Cells of the table in which a draw finds its source.
CELLS = 1024


def word_count(text: Column) -> Column:
    r"""Number of maximal runs of characters other than space and U+0009 to U+000D; null gives 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def permuted(i: Column, n: Column, *key: Column, rounds: int = 3) -> Column:
    """The place of i in a keyed permutation of 0 .. n - 1. i and n: columns of long."""
    root = F.ceil(F.sqrt(n.cast("double"))).cast("long") + 1  # a root that is rounded down still gives radices with a product of n or more
    radix = F.struct(root.alias("a"), F.floor((n + root - 1) / root).cast("long").alias("b"))

    def half_round(pair: Column, k: Column) -> Column:
        a, b, left, right = (pair[c] for c in ("a", "b", "left", "right"))
        left = F.when(k % 2 == 0, (left + F.pmod(F.xxhash64(k, right, *key), a)) % a).otherwise(left)
        right = F.when(k % 2 == 1, (right + F.pmod(F.xxhash64(k, pair["left"], *key), b)) % b).otherwise(right)
        return F.struct(a.alias("a"), b.alias("b"), left.alias("left"), right.alias("right"))

    def shuffled(x: Column, ab: Column) -> Column:
        start = F.struct(ab["a"].alias("a"), ab["b"].alias("b"), F.floor(x / ab["b"]).cast("long").alias("left"), (x % ab["b"]).alias("right"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(2 * rounds - 1)), start, half_round, lambda pair: pair["left"] * pair["b"] + pair["right"])

    def step(walk: Column, k: Column) -> Column:
        at = F.when((k > 0) & (walk["at"] < n), walk["at"]).otherwise(shuffled(walk["at"], walk["ab"]))
        return F.struct(at.alias("at"), walk["ab"].alias("ab"))

    def end(walk: Column) -> Column:
        return F.when(walk["at"] < n, walk["at"]).otherwise(F.raise_error(F.lit("a cycle walk did not end")).cast("long"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(WALK_STEPS)), F.struct(i.alias("at"), radix.alias("ab")), step, end)


def source_targets(sizes: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, weight, size) to targets: adds target double.

    Runs over one row per source; the ordered windows hold that table only.
    """
    least = F.when(F.col("weight") > 0, max_repeat * F.col("size") / F.col("weight"))
    order = Window.orderBy("__limit", "source_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    held = sizes.withColumn("__limit", least)
    held = held.withColumns({"__words": F.sum("size").over(every), "__weights": F.sum("weight").over(every)})
    held = held.withColumns({"__cap": F.coalesce(F.sum(max_repeat * F.col("size")).over(before), F.lit(0)), "__gone": F.coalesce(F.sum("weight").over(before), F.lit(0))})
    held = held.withColumn("__rate", (F.col("__words") - F.col("__cap")) / (F.col("__weights") - F.col("__gone")))
    # in this order, the first source that its rate does not lift over its limit fixes the rate of all that follow
    held = held.withColumn("__free", F.col("__rate") <= F.col("__limit"))
    rate = F.min_by(F.when(F.col("__free"), F.col("__rate")), F.when(F.col("__free"), F.struct("__limit", "source_no"))).over(every)
    target = F.least(rate * F.col("weight"), max_repeat * F.col("size").cast("double"))
    return held.withColumn("target", F.coalesce(target, max_repeat * F.col("size").cast("double"))).drop("__limit", "__words", "__weights", "__cap", "__gone", "__rate", "__free")


def cyclic_weight(number: Column, cycle: tuple[int, ...] = (1, 2, 3)) -> Column:
    """Weights in the order of sources, repeating."""
    return F.element_at(F.array(*map(F.lit, cycle)), (number % len(cycle) + 1).cast("int"))


def pack(docs: DataFrame, seed: int = 7, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", block_words: int = BLOCK_WORDS, max_repeat: int = MAX_REPEAT, weight=cyclic_weight) -> tuple[DataFrame, DataFrame]:
    """(sources, placed): sources with source_no, weight, size, target and slots; documents with their place in their source's stream.

    The running sums go over buckets of documents, then within buckets, so that no task holds a whole source.
    """
    sized = materialise(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "mix-sizes")
    buckets = max(1, sized.count() // BUCKET_DOCS)
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(buckets)))
    by_bucket = materialise(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")), "mix-buckets")
    sources = by_bucket.groupBy("source").agg(F.sum("words").alias("size"))
    sources = sources.withColumn("source_no", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))).cast("long") - 1)
    sources = source_targets(sources.withColumn("weight", weight(F.col("source_no"))), max_repeat)
    due = F.least(F.round("target").cast("long"), max_repeat * F.col("size"))
    sources = sources.withColumns({"due": due, "blocks": F.ceil(F.col("size") / block_words).cast("long")})
    passes = F.when(F.col("size") > 0, F.floor(F.col("due") / F.col("size"))).otherwise(0).cast("long")
    sources = sources.withColumn("passes", passes).withColumn("rest", F.col("due") - F.col("passes") * F.col("size"))
    sources = sources.withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block_words).cast("long"))
    ahead = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    sources = sources.withColumns({"first_slot": F.coalesce(F.sum("slots").over(ahead), F.lit(0)), "all_slots": F.sum("slots").over(Window.partitionBy(F.lit(0)))})
    sources = materialise(sources, "mix-sources")

    within = Window.partitionBy("source", "bucket").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_bucket.withColumn("bucket_start", F.coalesce(F.sum("words").over(over), F.lit(0))).drop("words", "n")
    placed = sized.withColumn("__at", F.coalesce(F.sum("size").over(within), F.lit(0)))
    keys = sources.select(F.col("source").alias("__s"), "source_no", F.col("size").alias("source_size"), "target")
    starts = starts.join(maybe_broadcast(keys), F.col("source").eqNullSafe(F.col("__s"))).select(F.col("source").alias("__s"), F.col("bucket").alias("__b"), "bucket_start", "source_no", "source_size", "target")
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("__s")) & (F.col("bucket") == F.col("__b")))
    return sources, placed.withColumn("start", F.col("bucket_start") + F.col("__at")).drop("__s", "__b", "__at", "bucket_start", "bucket")


def running(rows: DataFrame, value: str, out: str) -> DataFrame:
    """rows (shard, source_no, …) with the sum of value over the source's earlier shards. Sums go over groups of shards, then within them, so no task holds all shards of a source."""
    rows = rows.withColumn("__g", F.floor(F.col("shard") / SHARD_GROUP))
    sums = rows.groupBy("source_no", "__g").agg(F.sum(value).alias("__v"))
    start = F.coalesce(F.sum("__v").over(Window.partitionBy("source_no").orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("source_no", "__g", start.alias("__start"))
    within = F.coalesce(F.sum(value).over(Window.partitionBy("source_no", "__g").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__w", within).join(sums, ["source_no", "__g"]).withColumn(out, F.col("__start") + F.col("__w")).drop("__g", "__w", "__start")


def shard_counts(sources: DataFrame, seed: int = 7, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """shard, source_no, n: multinomial draws of the sources of each shard's slots, corrected in the last shards to the sources' slots."""
    spark = sources.sparkSession
    total = sources.agg(F.sum("slots")).first()[0] or 0  # one number
    width = max(1, -(-total // CELLS))
    last = F.col("first_slot") + F.col("slots") - 1
    cells = sources.filter("slots > 0").withColumn("cell", F.explode(F.sequence(F.floor(F.col("first_slot") / width), F.floor(last / width)))).select("cell", "source_no", F.col("first_slot").alias("from"), last.alias("to"))
    chunks = spark.range(0, -(-total // CHUNK), 1, max(1, total // (8 * CHUNK))).withColumn("x", F.explode(F.sequence(F.col("id") * CHUNK, F.least((F.col("id") + 1) * CHUNK, F.lit(total)) - 1)))
    draws = chunks.select(F.floor(F.col("x") / shard_slots).alias("shard"), F.pmod(F.xxhash64(F.lit(seed + 2), "x"), F.lit(max(total, 1))).alias("u")).withColumn("cell", F.floor(F.col("u") / width))
    drawn = draws.join(maybe_broadcast(materialise(cells, "mix-cells")), "cell").filter("u between from and to").groupBy("shard", "source_no").agg(F.count(F.lit(1)).alias("n"))
    drawn = running(materialise(drawn, "mix-draws"), "n", "before").join(maybe_broadcast(sources.select("source_no", "slots")), "source_no")
    # a source keeps its draws up to its slots; the others are open
    kept = F.least(F.col("before") + F.col("n"), "slots") - F.least("before", "slots")
    drawn = materialise(drawn.select("shard", "source_no", "n", kept.alias("kept")), "mix-kept")
    # as many open slots as sources lack: a share of about 1 / sqrt(total)
    order = Window.orderBy("shard", "source_no").rowsBetween(Window.unboundedPreceding, -1)
    free = drawn.filter("n > kept").withColumn("k", F.col("n") - F.col("kept")).withColumn("at", F.coalesce(F.sum("k").over(order), F.lit(0)))
    free = free.select("shard", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("k") - 1)).alias("q"))
    lack = sources.select("source_no", "slots").join(drawn.groupBy("source_no").agg(F.sum("kept").alias("kept")), "source_no", "left").withColumn("k", F.col("slots") - F.coalesce("kept", F.lit(0))).filter("k > 0")
    lack = lack.withColumn("at", F.coalesce(F.sum("k").over(Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    lack = lack.select("source_no", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("k") - 1)).alias("q"))
    given = free.join(lack, "q").groupBy("shard", "source_no").agg(F.count(F.lit(1)).alias("n"))
    out = drawn.select("shard", "source_no", F.col("kept").alias("n")).unionByName(given)
    return materialise(out.groupBy("shard", "source_no").agg(F.sum("n").alias("n")).filter("n > 0"), "mix-shards")


def slots(sources: DataFrame, seed: int = 7, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """One row per slot of the mix: shard, place, source_no, block, words (of the block, from its start)."""
    counts = running(shard_counts(sources, seed, shard_slots), "n", "first")
    ahead = Window.partitionBy("shard").orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"offset": F.coalesce(F.sum("n").over(ahead), F.lit(0)), "held": F.sum("n").over(Window.partitionBy("shard"))})
    parts = sources.agg(F.ceil(F.coalesce(F.sum("slots"), F.lit(0)) / (8 * CHUNK)).cast("int")).first()[0]
    rows = counts.join(maybe_broadcast(sources.select("source_no", "size", "blocks", "passes", "rest")), "source_no").repartition(max(1, parts), "shard", "source_no")
    out = rows.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("i", F.col("first") + F.col("j"))
    turn, at = F.floor(F.col("i") / F.col("blocks")).cast("long"), F.col("i") % F.col("blocks")
    full = F.col("blocks") - 1
    out = out.withColumns({"turn": turn, "at": at})
    block = F.when(F.col("at") == full, full).otherwise(permuted(F.col("at"), F.greatest(full, F.lit(1).cast("long")), F.lit(seed), F.col("source_no"), F.col("turn")))
    length = F.when(F.col("at") == full, F.col("size") - full * block_words).otherwise(F.lit(block_words).cast("long"))
    left = F.when(F.col("turn") < F.col("passes"), length).otherwise(F.least(length, F.col("rest") - F.col("at") * block_words))
    place = permuted(F.col("offset") + F.col("j"), F.col("held"), F.lit(seed + 1), F.col("shard"))
    return out.select("shard", place.alias("place"), "source_no", block.alias("block"), left.alias("words"))


def pieces(placed: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents cut at the blocks of their source: block, piece_from and piece_to (words within the block)."""
    end = F.col("start") + F.col("size")
    cut = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words))))
    base = F.col("block") * block_words
    return cut.withColumns({"piece_from": F.greatest(F.col("start") - base, F.lit(0)), "piece_to": F.least(end - base, F.lit(block_words).cast("long"))})


def mix(sources: DataFrame, placed: DataFrame, seed: int = 7, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """One row per piece of a document in a slot: shard, place, source_no, start (of the document), doc_id, source, block, piece_from, piece_to."""
    # both sides grow with the input, which Spark can't tell from an explode: no broadcast
    written = materialise(slots(sources, seed, block_words, shard_slots), "mix-slots")
    joined = pieces(placed, block_words).join(written.hint("merge"), ["source_no", "block"])
    return joined.withColumn("piece_to", F.least("piece_to", "words")).filter("piece_to > piece_from").select("shard", "place", "source_no", "start", "source", "doc_id", "block", "piece_from", "piece_to")


def mixed_blocks(docs: DataFrame, seed: int = 7, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, **more) -> DataFrame:
    """The mix itself: one row per piece of a document in a slot, with shard, place, piece_from and piece_to."""
    sources, placed = pack(docs, seed, block_words=block_words, **more)
    return mix(sources, placed, seed, block_words, shard_slots).drop("source_no", "start")


def taken_words(docs: DataFrame, seed: int = 7, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, **more) -> DataFrame:
    """One row per document: doc_id, size, source_size, target and taken, the words of it in the mix, repeats counted."""
    sources, placed = pack(docs, seed, block_words=block_words, **more)
    placed = materialise(placed, "mix-placed")
    mixed = mix(sources, placed, seed, block_words, shard_slots)
    taken = mixed.groupBy("source_no", "start").agg(F.sum(F.col("piece_to") - F.col("piece_from")).alias("taken"))
    some = placed.filter("size > 0").join(taken.hint("merge"), ["source_no", "start"], "left")
    none = placed.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return some.unionByName(none).select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")
