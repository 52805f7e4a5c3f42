import pytest
from pyspark.sql import functions as F

from gradeline.functions import scores as S, text as X


def one(spark, col, **values):
    row = spark.createDataFrame([tuple(values.values())] if values else [(1,)], list(values) or ["_"])
    return row.select(col.alias("r")).first().r


@pytest.mark.parametrize("text, out", [("אב $x+1$ ג, 12", "אב ג 12"), ("[[deleted: אב]] ג", "ג"), ("שָׁלֵם", "שלם"), ("", ""), ("abc", ""), ("$$a$$ א", "א")])
def test_prose(spark, text, out):
    assert one(spark, X.prose("t"), t=text) == out


def test_prose_of_null(spark):
    assert spark.sql("select cast(null as string) t").select(X.prose("t").alias("r")).first().r == ""


@pytest.mark.parametrize("a, b, rate", [("", "", 0.0), ("א", "", 1.0), ("", "א", 1.0), ("אבגד", "אבגה", 0.25), ("א", "אבגד", 3.0)])
def test_error_rate(spark, a, b, rate):
    assert one(spark, X.error_rate(F.col("a"), F.col("b")), a=a, b=b) == rate


def test_formulas(spark):
    assert one(spark, X.formulas("t"), t="$$a=b$$ x $c$") == ["a=b", "a=b", "x"]  # the inline pattern reads on from the display one
    assert one(spark, X.formulas("t"), t="x $c$ and $ d $") == ["c", "d"]
    assert one(spark, X.all_formulas(F.array(F.lit(r"\dfrac12="), F.lit("מילה"), F.lit("a")), F.lit("$a$ $x^2$"))) == [r"\frac12", "a", "x^2"]


@pytest.mark.parametrize("label, out", [("שאלה 12", "12"), ("q 3 b", "3"), ("  ", "unknown"), ("abc", "abc"), ("2031", "2031")])
def test_question_id(spark, label, out):
    assert one(spark, X.question_id("t"), t=label) == out


@pytest.mark.parametrize("text, out", [("0.4\\cdot0.95=0.38", "0.38"), ("a ≈ 3 → 4", "4"), ("x=", "x"), ("", ""), ("1/2", "1/2"), ("a\\to 5", "5")])
def test_result_segment(spark, text, out):
    assert one(spark, X.result_segment("t"), t=text) == out


def test_names_and_hashes(spark):
    assert one(spark, X.safe_name("t"), t="a/b שאלה-1") == "a_b_שאלה-1"
    assert one(spark, X.slug("t"), t="a/b:c") == "a_b_c"
    assert one(spark, X.digest("t", 16), t="abc") == "ba7816bf8f01cfea"
    assert one(spark, X.stem("t"), t="/a/b.c/page_001.png") == "page_001"
    assert one(spark, X.extension("t"), t="/a/x.PDF") == ".pdf"
    assert one(spark, X.unfenced("t"), t="```json\n{}\n```") == "{}"
    assert one(spark, X.option_text("t"), t="$ 40\\% $") == "40%"
    assert one(spark, X.option_text("t"), t='אף אחד מהנ"ל') == X.NONE_OF_THE_ABOVE
    assert one(spark, X.pseudonym("t"), t="b1").startswith("STUDENT_")
    assert one(spark, X.number("t", "int"), t="x") == 0


@pytest.mark.parametrize(
    "blank, content, n, rate, flags, own, out",
    [(True, True, 1, 1.0, 0, 0.9, 0.95), (False, False, 0, 1.0, 0, None, 0.15), (False, True, 0, 1.0, 0, None, 0.92), (False, True, 4, 0.75, 2, None, 0.61), (False, True, 4, 1.0, 0, 1.0, 0.967), (False, True, 2, 0.0, 9, None, 0.05)],
)
def test_confidence(spark, blank, content, n, rate, flags, own, out):
    df = spark.createDataFrame([(blank, content, n, rate, flags, own)], "b boolean, c boolean, n int, r double, f int, o double")
    assert df.select(S.confidence(*map(F.col, "bcnrfo")).alias("r")).first().r == out


def test_box_is_repaired(spark):
    b = spark.range(1).select(S.box(*map(F.lit, (0.5, 0.75, 0.25, 0.25)), F.lit(100), F.lit(200)).alias("b")).first().b
    assert tuple(b) == (25, 50, 25, 100)
    b = spark.range(1).select(S.box(*map(F.lit, (1.0, 1.0, 1.0, 1.0)), F.lit(10), F.lit(10)).alias("b")).first().b
    assert tuple(b) == (9, 9, 1, 1)


def test_aggregates_of_nothing(spark):
    e = spark.createDataFrame([], "x double, y double")
    r = e.agg(S.centre(F.col("x")).alias("c"), S.strict_sum(F.col("x")).alias("s"), S.pearson(F.col("x"), F.col("y")).alias("p")).first()
    assert (r.c, r.s, r.p) == (0.0, None, None)
    v = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 1.0)], "x double, y double")
    r = v.agg(S.centre(F.col("y")).alias("c"), S.strict_sum(F.col("x")).alias("s"), S.pearson(F.col("x"), F.col("y")).alias("p")).first()
    assert (r.c, r.s, r.p) == (2.0, None, None)


def test_dpi_and_colour(spark):
    df = spark.createDataFrame([([1500.0, 400.0],), ([400.0],), ([],)], "w array<double>")
    assert [r.r for r in df.select(S.effective_dpi(F.col("w"), F.lit(10.0), 300).alias("r")).collect()] == [150, 300, 300]
    assert one(spark, S.is_red(F.col("c")), c=0xC01010) is True and one(spark, S.is_red(F.col("c")), c=0xC0F010) is False
    assert one(spark, S.suit(*map(F.lit, (0.5, 1, 0.5, 0.5)))) == "heart" and one(spark, S.suit(*map(F.lit, (0.9, 1, 0.5, 0.5)))) is None
