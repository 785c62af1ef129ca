"""All numbered queries and the pipeline over the smallest tables, against SQL or brute force."""

import os

import duckdb
import pytest

from colloquy.llm import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    relation = con.sql(Q.oracle_sql()[name])
    got = Q.queries()[name](spark, SF)
    rows = sorted((tuple(r[c] for c in relation.columns) for r in got.collect()), key=str)
    assert rows == sorted(relation.fetchall(), key=str)


def brute_near(rows):
    """Ids that stay: the smallest of each component of near copies."""
    from test_near_and_substrings import brute_components

    return {label for _, label in brute_components([(r.doc_id, r.text) for r in rows]).values()}


def brute_contaminated(rows, items):
    from test_texts import plain_matches

    return {r.doc_id for r in rows if any(plain_matches(r.text or "", i.text) for i in items)}


def test_pipeline_is_that_of_plain_loops(spark):
    import corpus_pipeline as P
    from colloquy.llm import quality
    from colloquy.llm.common import materialise

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    assert [n for n, _ in P.STAGES] == ["quality classifier", "exact dedup", "near dedup", "benchmark decontamination", "mixing"]
    columns, counts = docs.columns, [docs.count()]
    for number, (_, stage) in enumerate(P.STAGES):
        before, docs = docs, materialise(stage(spark, docs, SF), "test-stage")
        rows, ids = before.collect(), {r.doc_id for r in docs.select("doc_id").collect()}
        counts.append(docs.count())
        assert number == 4 or docs.columns == columns
        if number == 0:
            assert ids == {r.doc_id for r in quality.report(before, labels).filter("score >= 0.3").collect()}
        if number == 1:  # of equal texts the row with the largest id stays
            best = {}
            for r in rows:
                best[r.text] = max(best.get(r.text, r.doc_id), r.doc_id)
            assert ids == set(best.values())
        if number == 2:
            assert ids == brute_near(rows)
        if number == 3:
            assert ids == {r.doc_id for r in rows} - brute_contaminated(rows, items)
        if number == 4:
            import re

            size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
            of, got = {r.doc_id: r.source for r in rows}, docs.collect()
            assert {r.doc_id: r.size for r in got} == size and all(r.taken <= 3 * r.size for r in got)
            for s in set(of.values()):
                mine = [r for r in got if of[r.doc_id] == s]
                assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1
    assert counts[0] > counts[1] >= counts[2] > counts[3] > counts[4] == counts[5]
    again = sorted(map(tuple, P.run(spark, SF).collect()))
    assert again == sorted(map(tuple, docs.collect()))
