from qiyas.llm import jaccard_join as jj

A = "some plain words that stand here as one long text of a document"
B = "quite other words make the second text that nobody else has written"
A2 = A.replace(" ", "  ")


def kept(spark, rows):
    df = spark.createDataFrame([(*r, f"s{i}") for i, r in enumerate(rows)], "doc_id long, text string, source string").repartition(3)
    got = jj.representatives(df)
    assert got.columns == df.columns
    return sorted(((r.doc_id, r.text) for r in got.collect()), key=str)


def test_one_row_of_each_component_stays(spark):
    # copies without an id of each other and of a row with one
    rows = [(None, A), (None, A), (None, A2), (7, B), (None, B), (None, B), (None, "12 words of its own alone"), (None, None), (None, None), (None, "")]
    got = kept(spark, rows)
    assert sum(t in (A, A2) for _, t in got) == 1
    assert [x for x in got if x[1] not in (A, A2)] == sorted([(7, B), (None, "12 words of its own alone"), (None, None), (None, None), (None, "")], key=str)
    # equal ids and unequal texts of one component
    assert len(kept(spark, [(3, A), (3, A2)])) == 1
    # equal ids in two components: each component keeps one
    assert kept(spark, [(2, B), (3, B), (3, A)]) == sorted([(2, B), (3, A)], key=str)
    # one document in two rows
    assert kept(spark, [(3, A), (3, A), (4, A2)]) == [(3, A), (3, A)]
