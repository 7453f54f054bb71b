import pytest

from lexivec.operators import evaluate

ROWS = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("a", "unknown"), ("z", "a"), ("a", "z"), (None, "a"), ("b", None)]


def table(spark, rows):
    return spark.createDataFrame(rows, "truth string, guess string")


def test_confusion_matrix(spark):
    matrix = evaluate.confusion_matrix(table(spark, ROWS), ["a", "b", "c"])
    cells = {(r["guess"], r["truth"]): r["n"] for r in matrix.collect()}
    assert len(cells) == 9
    assert {c: n for c, n in cells.items() if n} == {("a", "a"): 1, ("b", "a"): 1, ("b", "b"): 2}


def test_metrics(spark):
    matrix = evaluate.confusion_matrix(table(spark, ROWS), ["a", "b", "c"])
    rated = evaluate.label_metrics(matrix)
    rows = {r["label"]: tuple(r)[1:] for r in rated.collect()}
    # F of b from the rounded precision 0.6667 and recall 1.
    assert rows == {"a": (1.0, 0.5, 0.6667), "b": (0.6667, 1.0, 0.8), "c": (0.0, 0.0, 0.0)}
    assert tuple(evaluate.macro_metrics(rated).first()) == (0.5556, 0.5, 0.4889)


def test_nothing_counted(spark):
    matrix = evaluate.confusion_matrix(table(spark, [("a", "unknown")]), ["a", "b"])
    rated = evaluate.label_metrics(matrix)
    assert rated.collect() == []
    assert tuple(evaluate.macro_metrics(rated).first()) == (None, None, None)


@pytest.mark.parametrize("labels", [[], ["a"], "ab"])
def test_two_labels_are_needed(spark, labels):
    with pytest.raises(ValueError, match="two class labels"):
        evaluate.confusion_matrix(table(spark, ROWS), labels)


def test_value_freq(spark):
    rows = evaluate.value_freq(table(spark, ROWS), "truth").collect()
    assert {r["value"]: r["n"] for r in rows} == {"a": 4, "b": 3, "z": 1, None: 1}
