"""The bound on labelled ids bounds the rows that a fitting task gets."""

from marketloom.llm import quality


def test_one_text_per_id_though_a_third_of_the_rows_share_one(spark):
    rows = [(1, f"text {k}") for k in range(1000)] + [(2, None), (2, "b"), (2, "b")] + [(k, "other") for k in range(3, 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1)], "doc_id long, quality int")
    sample = quality.labelled_sample(labels, "quality")
    got = {(r.doc_id, r.label): r.text for r in quality.sampled_texts(docs, sample).collect()}
    assert set(got) == {(1, 1), (2, 0)}
    again = {(r.doc_id, r.label): r.text for r in quality.sampled_texts(docs.repartition(3), sample).collect()}
    assert got == again
