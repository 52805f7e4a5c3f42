import pytest

from gradeline.llm import looks as L


@pytest.mark.parametrize(
    "a, b",
    [("сор", "cop"), ("ｆｏｏ１２", "foo12"), ("cafe\u0301", "café"), ("ש\u05c1ל", "ש\u05c1\u200dל"), ("\ufb2a", "ש\u05c1"), ("ℵ", "א"), ("a\u00adb", "ab"), ("12׃", "12:"), ("ב\u05bc\u05b8", "ב\u05b8\u05bc"), ("ΡΕ", "PE"), ("выбoр", "выбор"), ("‐", "-"), ("ǀx˂", "|x<"), ("α", "a"), ("νim", "vim"), ("…", "..."), ("ﬁx", "fix"), ("ﭏ", "אל"), ("װ", "וו"), ("5−3", "5-3"), ("µ", "μ"), ("Ⅷ", "VIII"), ("օk", "ok"), ("fסo", "foo"), ("ס", "o")],
)
def test_same_look(a, b):
    assert L.fold(a) == L.fold(b)


@pytest.mark.parametrize("a, b", [("x²", "x2"), ("a", "A"), ("1", "l"), ("é", "e"), ("שָ", "ש"), ("½", "1⁄2"), ("—", "-"), ("א", "ע"), ("σο", "οο"), ("סוס", "oוo"), ("ſ", "s"), ("①", "1")])
def test_other_look(a, b):
    assert L.fold(a) != L.fold(b)


def test_script_resolution():
    assert L.fold("выбoр") == "выбор"  # a Latin o in a Cyrillic word
    assert L.fold("сop") == "cop" and L.resolve("сop")[1] is True
    assert L.resolve("сор")[2] is True and L.resolve("выбор")[2] is False
    assert L.fold(L.fold("ｃａｆé")) == L.fold("ｃａｆé")


def test_white_space_and_lines():
    assert L.fold_text("a\u00a0 b \n\u2009c\u200b", {}) == "a b\nc"
    assert L.fold_text("a\n\nb", {}) != L.fold_text("a\nb", {})


def test_pairs(spark):
    rows = [("1", "abc x"), ("2", "аbс x"), ("3", "abc\u00a0x"), ("3", "abc\u00a0x"), ("4", "abc y"), ("5", None), ("6", ""), ("7", "  "), ("8", "abc x"), (None, "abc x"), ("9", "\n"), ("10", "\u00a0"), ("11", "\u200b\n"), ("12", "\u00ad")]
    t = spark.createDataFrame(rows, "id string, transcript string").selectExpr("*", "1 as field", "2 as look", "3 as canonical")
    m = spark.createDataFrame([("1", "abc x")], "transcript_id string, hebrew_text string")
    texts = L.all_texts({"curated_cases": t, "transcriber": m})
    assert {(r.id_a, r.id_b) for r in L.look_pairs(texts).collect()} == {("1", "2"), ("1", "3"), ("2", "3"), ("2", "8"), ("3", "8")}
    got = {r.id: (r.n_spellings, r.n_records) for r in L.look_classes(texts).where("field = 'curated_cases.transcript'").collect()}
    assert got["1"] == (3, 4) and got["4"] == (1, 1) and "5" not in got
    flags = {r.id: (r.n_mixed, r.n_confusable) for r in L.look_classes(texts).collect()}
    assert flags["2"] == (1, 0) and flags["1"] == (0, 0) and not {"9", "10", "11", "12"} & set(flags)
    assert L.look_pairs(texts.limit(0)).count() == 0 and L.look_classes(texts.limit(0)).count() == 0


def test_flags(spark):
    rows = spark.createDataFrame([("f", "a", "сор выбoр выбор plain"), ("f", "b", "של סוס")], "field string, id string, text string")
    assert {r.id: (r.n_mixed, r.n_confusable) for r in L.keyed(rows).collect()} == {"a": (1, 1), "b": (0, 0)}


def test_spellings_are_paired_before_records(spark):
    rows = [(str(k), "abc x") for k in range(300)] + [("u", "аbс x"), ("v", "abc\u00a0x")]
    texts = spark.createDataFrame([("f", *r) for r in rows], "field string, id string, text string")
    got = {(r.id_a, r.id_b) for r in L.look_pairs(texts).collect()}
    assert len(got) == 601 and all({"u", "v"} & set(p) for p in got)


def test_canonical_keeps_columns(spark):
    df = spark.createDataFrame([("ａ", 1), (None, 2), ("", 3)], "text string, look int")
    assert [tuple(r) for r in L.canonical(df, "text").collect()] == [("ａ", 1, "a"), (None, 2, None), ("", 3, "")]
    assert df.columns == ["text", "look"]
    with pytest.raises(ValueError):
        L.canonical(df, "text", "look")


def test_all_copies_of_one_spelling(spark):
    rows = spark.range(2000).selectExpr("'f' as field", "cast(id as string) as id", "'same text' as text")
    assert L.look_pairs(rows).count() == 0
