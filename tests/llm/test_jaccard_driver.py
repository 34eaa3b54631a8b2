"""What the Jaccard join asks of the driver: jobs, and small tables broadcast from it."""

from helioframe.llm import components as stars
from helioframe.llm import jaccard
from tests.llm.test_jaccard_size import passage_pages


def test_components_broadcast_nothing(spark, monkeypatch):
    plans, persist = [], stars.persist_table

    def looked_at(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return persist(df, label)

    monkeypatch.setattr(stars, "persist_table", looked_at)
    edges = spark.createDataFrame([(k, k + 1) for k in range(8)] + [(20, 21), (21, 20), (5, 5)], "a bigint, b bigint")
    got = {(r.node, r.label) for r in stars.components(edges).collect()}
    assert got == {(k, 0) for k in range(9)} | {(20, 20), (21, 20)}
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_regions_are_stored_before_their_pairs_are_made(spark, monkeypatch):
    stored, persist = {}, jaccard.persist_table

    def looked_at(df, label):
        stored.setdefault(label, []).append(df._jdf.queryExecution().optimizedPlan().toString())
        return persist(df, label)

    monkeypatch.setattr(jaccard, "persist_table", looked_at)
    monkeypatch.setattr(jaccard, "LEAF", 2)
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    rows = passage_pages(24)
    got = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(k, 0 if k > 23 else k) for k in range(26)}
    # regions are neither counted nor labelled again in the plan that makes their pairs
    assert len(stored["pairs-left-met"]) == 1
    assert "count(1)" not in stored["pairs-left-met"][0] and "bit_xor" not in stored["pairs-left-met"][0]
