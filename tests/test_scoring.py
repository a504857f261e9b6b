"""Golden answers for extraction and grading."""

import pytest

from tessella.functions import scoring as S


@pytest.mark.parametrize(("text", "want"), [
    ("a \\boxed{\\frac{1}{2}} b", "\\frac{1}{2}"), ("\\boxed{1} then \\boxed{2}", "2"), ("\\boxed{un", None), ("no", None), ("\\fbox{3}", "3"), ("so \\boxed 7$ .", "7"), (None, None), ("", None),
])
def test_last_boxed(text, want):
    assert S.last_boxed(text) == want


@pytest.mark.parametrize(("a", "b", "same"), [
    ("0.5", "\\frac{1}{2}", True), ("1/2", "\\frac12", True), ("\\dfrac{3}{4}", "0.75", True), ("(1,2)", "(1, 2)", True), ("(1,2)", "[1,2]", False), ("(1,2)", "(2,1)", False), ("50\\%", "50", True), ("1,234", "1234", True), ("x=5", "5", True),
    ("2", "3", False), ("\\sqrt3", "\\sqrt{3}", True), ("", "", False), (None, "1", False), (".5", "0.5", True), ("5 \\text{ cm}", "5", True), ("a", "a", True), ("a", "b", False), ("1/0", "1", False), ("__import__('os')", "1", False),
])
def test_math_equal(a, b, same):
    assert S.math_equal(a, b) is same


def test_grade_is_strict_on_integers_and_fractions():
    assert S.grade_answer("4", "4") and S.grade_answer("4.0", "4") and not S.grade_answer("\\frac{2}{4}", "\\frac{1}{2}") and S.grade_answer("0.5", "\\frac{1}{2}")


def test_many_answer_tags_cost(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("<answer>x</answer>" * 11, "x"), ("<answer>the X.</answer>", "x"), ("x", "x")], "t string, y string")
    assert [r[0] for r in df.select(S.qa_exact(F.col("t"), F.col("y"))).collect()] == [0.25, 1.0, 0.0]
    n = spark.createDataFrame([("Answer: \\frac12", "\\frac{1}{2}"), ("answer: 1,234 dollars", "1234"), ("nothing", "3")], "t string, y string")
    assert [r[0] for r in n.select(S.minerva_score(F.col("t"), F.col("y"))).collect()] == [1.0, 1.0, -1.0]


def test_registry_and_custom_scorers(spark, tmp_path):
    from pyspark.sql import functions as F

    from tessella.functions import registry as R

    (tmp_path / "own.py").write_text("def score(text, truth, bonus=0):\n    return {'score': len(text) + bonus}\n")
    f = R.load_scorer(str(tmp_path / "own.py"), "score", bonus=2)
    assert f("abc", "") == {"score": 5}
    df = spark.createDataFrame([("\\boxed{1/2}", "0.5"), (None, "1"), ("x", "2")], "t string, y string")
    assert [r.score for r in R.score_rows(df, "math", F.col("t"), F.col("y")).collect()] == [1.0, 0.0, 0.0]
    assert [r.score for r in R.score_rows(df, lambda a, b: len(a), F.col("t"), F.col("y")).collect()] == [11.0, 0.0, 1.0]
    with pytest.raises(ValueError):
        R.register_scorer("math")(len)
