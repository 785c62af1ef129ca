import hashlib

import pytest
from pyspark.sql import functions as F

from colloquy.llm import exact_dedup as E
from colloquy.llm import mixing as M

DOCS = "doc_id long, text string, source string, source_no int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 7) for i, t, s in rows], DOCS)


def test_report_with_nulls_ties_and_repeats(spark):
    rows = [(1, "a", "x"), (2, "a", "x"), (3, None, "x"), (4, "", "x"), (5, "b", "x"), (5, "b", "x"), (None, "c", "x"), (None, "d", "x"), (6, "c", "x")]
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in E.report(docs(spark, rows), keep="most").collect()), key=str)
    by = {}
    for g in got:
        by.setdefault(g[0], []).append(g)
    assert by[1][0][1:4] == (2, 2, False) and by[2][0][3] and by[3][0][1] == 4 and len(by[5]) == 2 and all(g[3] and g[2] == 2 for g in by[5])
    assert {g[1] for g in by[None]} == {6, None}
    assert by[4][0][4] == hashlib.sha256(b"").hexdigest()
    assert {r.doc_id for r in E.report(docs(spark, rows)).filter("kept").collect()} >= {1, 3, 5}


def test_colliding_digests_are_told_apart_by_bytes(spark):
    rows = [(1, "a", "x"), (2, "b", "x"), (3, "a", "x"), (4, "b", "x"), (5, "c", "x")]
    one = lambda text: F.lit("same")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in E.report(docs(spark, rows), digest=one, memtable_rows=2).collect()}
    assert got == {1: (1, 2), 3: (1, 2), 2: (2, 2), 4: (2, 2), 5: (5, 1)}


def test_drop_copies_keeps_columns_and_one_of_repeated_rows(spark):
    kept = E.drop_copies(docs(spark, [(1, "a", "x"), (1, "a", "x"), (2, "a", "y"), (3, "z", None)]))
    assert kept.columns == ["doc_id", "text", "source", "source_no"] and sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert E.drop_copies(docs(spark, [])).count() == 0


def test_runs_are_probed_before_they_are_merged(spark):
    rows = [(i, f"t{i % 60}" if i % 3 else f"u{i}", "x") for i in range(400)] + [(7, "t1", "x")] * 5
    table = docs(spark, rows).withColumnRenamed("source", "digest").repartition(5, "doc_id")
    best, n = {}, {}
    for i, t, _ in rows:
        best[t], n[t] = max(best.get(t, i), i), n.get(t, 0) + 1
    keyed = table.select(E.text_digest(F.col("text")).alias("digest"), F.pmod(F.xxhash64("text"), F.lit(97)).alias("slot"), F.col("doc_id").alias("id"))
    runs, filters = E.flush_runs(keyed, 16)
    assert runs.count() == runs.select("run", "digest").distinct().count() and filters.count() == runs.select("run").distinct().count() > 20
    assert {(r.most_id, r.n) for r in E.compact(runs, filters).collect()} == {(best[t], n[t]) for t in n if n[t] > 1}
    got = {(r.doc_id, r.keep_id, r.group_size) for r in E.report(table, keep="most", memtable_rows=16).collect()}
    assert got == {(i, best[t], n[t]) for i, t, _ in rows}
    kept = E.drop_copies(table, keep="most", memtable_rows=16)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == sorted(best.values())


def test_ids_that_are_no_numbers_raise(spark):
    with pytest.raises(TypeError, match="whole numbers"):
        E.report(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def water_fill(sizes, weights, total):
    target, held = {}, set()
    while True:
        rest, w = total - sum(3 * sizes[s] for s in held), sum(weights[s] for s in sizes if s not in held)
        target = {s: 3 * sizes[s] if s in held else rest * weights[s] / w for s in sizes}
        over = {s for s in sizes if s not in held and target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return target
        held |= over


def test_mixture_meets_targets(spark):
    sizes = {"a": 400, "b": 10, "c": 5, None: 300}
    rows = [(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate((s, part) for s, n in sizes.items() for part in (n // 2, n - n // 2, 0))]
    rows += [(99, None, "a"), (99, "w w", "a"), (99, "w w", "a")]
    sizes["a"] += 4
    got = M.taken_words(docs(spark, rows), block_words=8).collect()
    assert len(got) == len(rows) and sum(r.size for r in got) == sum(sizes.values())
    order = ["a", "b", "c", None]
    target = water_fill(sizes, {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}, sum(sizes.values()))
    for s in order:
        mine = [r for r in got if r.source == s]
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == sizes[s] and r.taken <= 3 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= 1
    again = M.taken_words(docs(spark, rows[::-1]), block_words=8)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, got), key=str)


def test_mixed_blocks_hold_what_is_taken(spark):
    rows = [(i, " ".join(["w"] * (5 + i % 7)), "ab"[i % 2]) for i in range(40)]
    blocks = M.mixed_blocks(docs(spark, rows), block_words=16)
    sums = {r.doc_id: r.n for r in blocks.groupBy("doc_id").agg(F.sum(F.col("piece_to") - F.col("piece_from")).alias("n")).collect()}
    assert sums == {r.doc_id: r.taken for r in M.taken_words(docs(spark, rows), block_words=16).collect() if r.taken}
    assert blocks.select("shard", "place").distinct().count() >= blocks.select("source", "block").distinct().count()


def test_shards_are_draws_that_meet_the_totals(spark):
    rows = [(i, " ".join(["w"] * 40), "aabc"[i % 4]) for i in range(800)]
    sources, _ = M.pack(docs(spark, rows), block_words=8)
    slots = {r.source_no: r.slots for r in sources.collect()}
    counts = M.shard_counts(sources, shard_slots=256).collect()
    total, shards = sum(slots.values()), {}
    for r in counts:
        shards.setdefault(r.shard, {})[r.source_no] = r.n
    assert {s: sum(c.get(s, 0) for c in shards.values()) for s in slots} == slots
    assert [sum(shards[k].values()) for k in sorted(shards)] == [256] * (total // 256) + ([total % 256] if total % 256 else [])
    spread = [c.get(0, 0) for k, c in sorted(shards.items()) if k < total // 256 - 2]
    p = slots[0] / total
    assert abs(sum(spread) / len(spread) - 256 * p) < 4 * (256 * p * (1 - p) / len(spread)) ** 0.5  # as binomial draws are
    assert 0.2 < sum((x - 256 * p) ** 2 for x in spread) / len(spread) / (256 * p * (1 - p)) < 4
    placed = M.mixed_blocks(docs(spark, rows), block_words=8, shard_slots=256).select("shard", "place").distinct().count()
    assert placed == total


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 64, 1000):
        got = [r[0] for r in spark.range(n).select(M.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3))).collect()]
        assert sorted(got) == list(range(n))


def test_empty_mixture(spark):
    assert M.taken_words(docs(spark, [])).count() == 0
