"""What the Jaccard join writes and moves."""

from collections import Counter

from helioframe.llm import jaccard


def passage_pages(n):
    """Pages that share a passage, a third of each; the last two are near copies of the first."""
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(k, " ".join(f"own{k}x{i}" for i in range(50)) + " " + passage) for k in range(n)]
    return [*rows, *[(n + k, rows[0][1].replace("own0x49", f"copy{k}")) for k in range(2)]]


def test_pairs_that_signatures_rule_out_are_not_written(spark, monkeypatch):
    met, persist = {}, jaccard.persist_table

    def counted(df, label):
        stored = persist(df, label)
        met[label] = stored.count()
        return stored

    monkeypatch.setattr(jaccard, "persist_table", counted)
    rows = passage_pages(24)
    got = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(k, 0 if k > 23 else k) for k in range(26)}
    assert met["sized-regions"] > 50 and met["pairs-met"] == 3


def test_documents_that_surely_stay_are_not_shuffled(spark):
    rows = passage_pages(40)
    rows = [*rows, rows[3], rows[3], (None, rows[4][1]), (None, None), (7, ""), (7, "")]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    assert Counter(r.doc_id for r in kept.collect()) == Counter([*range(40), 7, 7, None])
    _, mark, passed = kept._jdf.queryExecution().optimizedPlan().toString().partition("others(")
    assert mark and "Join" not in passed and "others(" not in passed
    assert "Union" in kept._jdf.queryExecution().optimizedPlan().toString()
