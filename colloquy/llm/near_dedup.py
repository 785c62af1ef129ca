"""Near-duplicate groups by circulant MinHash.

Signature: a first permutation scatters the shingles of a document over 2^32 places; a second one, shifted circularly
by k, gives coordinate k: the minimum over the shingles of P((place + k) mod 2^32). So two permutations make all
coordinates. Bands of coordinates are the keys under which documents meet; every link is then confirmed by the exact
Jaccard similarity of the full shingle sets.

Documents with equal sets (copies) are first gathered into classes; only class representatives go on. In a band's
bucket, not all pairs are formed:

1. all members meet the bucket's first and last member; confirmed links make components;
2. in buckets that still hold several components, documents that can't be linked with any other are set aside by an
   exact bound: shingles that no other open document has are in no intersection, so a document with more than a quarter
   of such shingles has no link;
3. the members that are left are dealt into blocks of bounded size, and block meets block; a task compares the two
   blocks by exact set sizes and emits only links that join different components, at most one per document.

So a group of n near copies costs about n comparisons if its original is there; where it isn't, pairs are counted
within tasks but never emitted, and two components of a bucket stay apart only if all their pairs there were compared.
Members of large buckets, copies of one set and partners of one leader meet their counterparts by salted joins.

Shingles are compared by 64-bit hashes of their words, sets by 128-bit digests.

Defined cases: null and empty texts, and those without words, have an empty set, are linked with nothing and kept.
Fewer than five words make one shingle. Rows that repeat are copies. Rows that repeat an id are one document, whatever
their texts: what is linked with one of them is linked with all, and all with words are reported with the same component. Null ids
are linked with nothing. Ids are whole numbers; others raise an error. Empty tables give empty results. Columns besides
id and text are ignored; ``keep_one`` keeps them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import words
from colloquy.llm.common import discard, materialise, salted_join, whole_ids
from colloquy.llm.components import components
from colloquy.llm.exact_dedup import filter_words, passes_filter

WIDTH = 5
THRESHOLD = 75
#: 32 bands of 4 coordinates: a pair at similarity 0.75 shares no band in 5 of a million cases.
BANDS, ROWS = 32, 4
#: Members and shingles of a bucket that one task compares with as many others.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 1 << 18
#: Shingles that are permuted at once; they stay in the processor's cache.
_BLOCK = 1 << 15


def _permuted(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit integers."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: np.ndarray, bounds: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Signatures (texts x size) of texts with non-empty shingle sets. The hashes' upper halves are their places under the first permutation."""
    places = (sets >> np.uint64(32)).astype(np.uint32)
    out = np.full((len(bounds) - 1, size), np.uint32(0xFFFFFFFF))
    a = 0
    while a < len(bounds) - 1:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + _BLOCK, "right")) - 1)
        for x in range(bounds[a], bounds[b], 16 * _BLOCK):  # more than once only for a very long text
            y = min(bounds[b], x + 16 * _BLOCK)
            here = places[x:y]
            cuts = np.maximum(bounds[a:b] - x, 0)
            for k in range(size):
                out[a:b, k] = np.minimum(out[a:b, k], np.minimum.reduceat(_permuted(here + np.uint32(k)), cuts))
        a = b
    return out


def distinct_sets(array: pa.Array, width: int = WIDTH):
    """(first row, sorted distinct shingles, bounds) for groups of texts."""
    for c in words.chunks(array):
        found, bounds = words.shingles(c.hashes, c.bounds, width)
        parts = [np.unique(found[bounds[i] : bounds[i + 1]]) for i in range(len(bounds) - 1)]
        yield c.first, np.concatenate(parts) if parts else found, np.cumsum([0, *map(len, parts)])


def band_keys(sets: np.ndarray, bounds: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> pa.ListArray:
    """The bucket keys (bands of them) of each text; texts with an empty set get keys that mean nothing."""
    some = np.flatnonzero(np.diff(bounds))
    keys = np.zeros((len(bounds) - 1, bands), np.uint64)
    if len(some):
        sig = signatures(sets, np.append(bounds[some], bounds[-1]), bands * rows).reshape(len(some), bands, rows)
        for k in range(rows):
            keys[some] += words.mixed(sig[:, :, k].astype(np.uint64) + np.uint64(k + 1)) * words.mixed(np.array([11 + k], np.uint64))
        keys[some] = words.mixed(keys[some] + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1).view(np.int64)))


def set_keys(sets: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Digests of the sets; null for empty ones."""
    return pa.array([hashlib.blake2b(sets[a:b].tobytes(), digest_size=16).hexdigest() if b > a else None for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.string())


def summarise(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (digest of the set; null if empty), bands (array of bucket keys)."""

    def run(batches):
        for batch in batches:
            for first, sets, bounds in distinct_sets(batch.column("text")):
                size = np.diff(bounds)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(size)), pa.array(size), set_keys(sets, bounds), band_keys(sets, bounds)], ["doc_id", "n_shingles", "set_key", "bands"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key string, bands array<long>")


def shared_buckets(rows: DataFrame) -> DataFrame:
    """bucket, node and the bucket's lo and hi (first and last node) of the buckets with two nodes or more. rows: node, bands."""
    rows = rows.select(F.explode("bands").alias("bucket"), "node")
    full = rows.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("__n")).filter("lo < hi")
    full = materialise(full, "bucket-sizes")
    out = materialise(salted_join(rows, full, ["bucket"], ["node"]), "buckets")
    discard(full)
    return out


def shingle_sets(docs: DataFrame) -> DataFrame:
    """set_key, shingles (sorted) of texts."""

    def run(batches):
        for batch in batches:
            for _, sets, bounds in distinct_sets(batch.column("text")):
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([set_keys(sets, bounds), lists], ["set_key", "shingles"])

    return docs.select("text").mapInArrow(run, "set_key string, shingles array<long>")


def leader_pairs(buckets: DataFrame) -> DataFrame:
    """(a, b) pairs of the first and the last node of each bucket with all its nodes."""
    met = buckets.select("node", F.explode(F.array("lo", "hi")).alias("leader")).filter("node <> leader")
    return met.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()


def open_sets(buckets: DataFrame, sets: DataFrame) -> DataFrame:
    """node, n and shingles of the nodes of buckets: the size of the set, and the shingles of it that another node has."""
    members = materialise(sets.join(buckets.select("node").distinct(), "node", "left_semi"), "members")
    held = members.select("node", F.explode("shingles").alias("s"))
    owned = held.groupBy("s").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("node")).filter("k = 1")
    own = owned.groupBy("node").agg(F.collect_list("s").alias("own"))  # bounded by the length of a text
    shared = F.when(F.col("own").isNull(), F.col("shingles")).otherwise(F.array_except("shingles", "own"))
    out = materialise(members.join(own, "node", "left").select("node", "n", shared.alias("shingles")), "open-sets")
    discard(members)
    return out


def several(buckets: DataFrame) -> DataFrame:
    """The rows of buckets that hold members of several components."""
    spread = buckets.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count(F.lit(1)).alias("__n")).filter("least < most").select("bucket", "__n")
    spread = materialise(spread, "bucket-sizes")
    out = materialise(salted_join(buckets, spread, ["bucket"], ["node"]), "open")
    discard(spread)
    return out


def block_links(buckets: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(a, b) links between members of different components of each bucket, as many as join them. buckets: bucket, node, label, n. sets: node, n, shingles (those that others have)."""
    many = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    blocks = buckets.groupBy("bucket").agg(many.alias("blocks"), F.count(F.lit(1)).alias("__n"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = salted_join(buckets, materialise(blocks, "bucket-sizes"), ["bucket"], ["node"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "label").join(sets, "node")

    def compare(table: pa.Table) -> pa.Table:
        ids, labels, n = (table.column(c).to_numpy() for c in ("node", "label", "n"))
        lists = table.column("shingles").combine_chunks()
        held = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        values = lists.flatten().to_numpy(zero_copy_only=False)
        _, at, k = np.unique(values, return_inverse=True, return_counts=True)
        rows, shared = np.repeat(np.arange(len(ids)), held), k[at] > 1
        rows, at = rows[shared], np.unique(at[shared], return_inverse=True)[1]
        common = np.zeros((len(ids), len(ids)), np.float32)
        for x in range(0, int(at.max()) + 1 if len(at) else 0, 4096):
            here = (at >= x) & (at < x + 4096)
            part = np.zeros((len(ids), 4096), np.float32)
            part[rows[here], at[here] - x] = 1
            common += part @ part.T
        linked = 100 * common >= threshold * (n[:, None] + n[None, :] - common)
        linked &= labels[:, None] != labels[None, :]
        root = {x: x for x in labels.tolist()}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        out = []
        for a, b in zip(*np.nonzero(np.triu(linked, 1))):
            x, y = top(labels[a].item()), top(labels[b].item())
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((ids[a].item(), ids[b].item()))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return dealt.groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """pairs (a, b) whose sets have 100 * intersection >= threshold * union. sets: node, shingles, n. A node with many pairs has its set sent to several tasks."""

    def side(rows: DataFrame, name: str) -> DataFrame:
        uses = rows.groupBy(name).agg(F.count(F.lit(1)).alias("__n"))
        return uses.join(sets.select(F.col("node").alias(name), F.col("n").alias(f"n{name}"), F.col("shingles").alias(f"s{name}")), name)

    total = pairs.count()
    near = salted_join(pairs, side(pairs, "a").drop("sa"), ["a"], ["b"], total=total)
    near = salted_join(near, side(pairs, "b").drop("sb"), ["b"], ["a"], total=total)
    near = materialise(near.filter(100 * F.least("na", "nb") >= threshold * F.greatest("na", "nb")), "pairs")
    both = salted_join(near, side(near, "a").drop("na"), ["a"], ["b"], total=total)
    both = salted_join(both, side(near, "b").drop("nb"), ["b"], ["a"], total=total)
    both = both.withColumn("common", F.size(F.array_intersect("sa", "sb")).cast("long"))
    out = materialise(both.filter(100 * F.col("common") >= threshold * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b"), "links")
    discard(near)
    return out


def links_and_labels(docs: DataFrame, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(summary, named): rows of summarise(); set_key, __n (rows) and component (smallest doc_id) of each distinct set."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    summary = materialise(summarise(docs), "minhash")
    some = summary.filter("set_key is not null and doc_id is not null")
    classes = some.groupBy("set_key").agg(F.min_by(F.struct("doc_id", "bands"), "doc_id").alias("r"), F.count(F.lit(1)).alias("__n"))
    # the number of a class is written with it, so it is the same whenever it is read
    classes = materialise(classes.select("set_key", F.col("r.doc_id").alias("rep"), F.col("r.bands").alias("bands"), "__n", F.monotonically_increasing_id().alias("node")), "classes")
    buckets = shared_buckets(classes.select("node", "bands"))
    # the texts of those that met someone: a filter of fixed size thins them out, the join decides
    met = materialise(classes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "set_key", "rep"), "met")
    texts = passes_filter(docs.withColumn("digest", F.col("doc_id").cast("string")), filter_words(met.select(F.col("rep").cast("string").alias("digest"))))
    texts = texts.join(met.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = shingle_sets(texts).join(met.select("set_key", "node"), "set_key").groupBy("node").agg(F.first("shingles").alias("shingles"))
    sets = materialise(sets.withColumn("n", F.size("shingles").cast("long")), "shingles")

    pairs = materialise(leader_pairs(buckets), "pairs")
    links = confirmed(pairs, sets, threshold)
    discard(pairs)
    # rows that repeat an id are one document
    split = some.groupBy("doc_id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).filter("lo < hi").select("doc_id")
    split = materialise(some.join(split, "doc_id", "left_semi").select("doc_id", "set_key").distinct(), "split-ids")
    if split.limit(1).count():
        nodes = materialise(split.join(classes.select("set_key", "node"), "set_key").select("doc_id", "node"), "split-nodes")
        links = links.unionByName(nodes.join(nodes.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b")).filter("a <> b"))
    labels = components(links)
    labelled = buckets.select("bucket", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    spread = several(labelled)
    shared = open_sets(spread, sets)
    discard(sets)
    able = shared.filter(100 * F.size("shingles").cast("long") >= threshold * F.col("n"))
    rest = several(spread.join(able.select("node", "n"), "node"))
    discard(spread)
    more = materialise(block_links(rest, able, threshold), "links")
    discard(rest, shared)
    if more.limit(1).count():
        first, labels = labels, components(links.unionByName(more))
        discard(first)
    named = classes.select("set_key", "rep", "__n", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = materialise(named, "named")
    least = named.groupBy("label").agg(F.min("rep").alias("component"), F.count(F.lit(1)).alias("__k"))
    out = salted_join(named.withColumnRenamed("__n", "rows"), least.withColumnRenamed("__k", "__n"), ["label"], ["node"])
    out = materialise(out.select("set_key", F.col("rows").alias("__n"), "component"), "components")
    discard(classes, buckets, met, labels, named, more)
    return summary, out


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(whole_ids(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"))
    summary, named = links_and_labels(docs, threshold)
    known = F.when(F.col("doc_id").isNotNull(), F.col("set_key"))
    out = salted_join(summary.select("doc_id", "n_shingles", known.alias("set_key")), named, ["set_key"], ["doc_id"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component, the one with the smallest id; all rows of the others go."""
    gone = report(docs, id_col, text_col).filter(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == F.col("__gone"), "left_anti")
