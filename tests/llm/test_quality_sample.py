from statloom.llm import quality_rules

from . import texts as X


def test_a_repeated_id_is_one_labelled_text(spark):
    rows = [(i, X.prose(40, i)) for i in range(6)] + [(100 + i, X.prose(40, 50 + i).upper()) for i in range(6)]
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows], "doc_id long, quality int")
    want = quality_rules.fit_quality(X.frame(spark, rows), labels, steps=20)
    got = quality_rules.fit_quality(X.frame(spark, rows + [rows[0]] * 30), labels, steps=20)
    assert (got.weights == want.weights).all() and (got.scale, got.shift) == (want.scale, want.shift)
