"""Answer keys and sheets: option sets, mapping of printed options to the master's, keys per version, graded sheets with evidence, hand marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import expr, text as X


def master_key(options: DataFrame, question: str, letters: list[str]) -> DataFrame:
    """(question, options, correct_letter, errors) from printed master options (question, letter, text, red): each question has just the ``letters``, and one of
    them is red. With another number of red ones there is no correct letter."""
    o = options.groupBy(question, "letter").agg(F.max("text").alias("text"), F.bool_or("red").alias("red"))
    g = o.groupBy(question).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("letter", F.coalesce("text", F.lit("")).alias("text"))))).alias("options"),
        F.count_if("red").alias("_n"), F.min(F.when(F.col("red"), F.col("letter"))).alias("_red"),
    )
    have = F.array_sort(F.map_keys("options"))
    errors = F.filter(F.array(
        F.when(F.col("_n") != 1, F.concat(F.col("_n").cast("string"), F.lit(" red options"))),
        F.when(have != F.array_sort(F.array(*map(F.lit, letters))), F.concat(F.lit("options "), F.array_join(have, ","))),
    ), lambda x: x.isNotNull())
    return g.select(question, "options", F.when(F.col("_n") == 1, F.col("_red")).alias("correct_letter"), errors.alias("errors"))


def equal_texts(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Adds ``equal`` to pairs of options: equal as texts, natively, else by value, in an Arrow pass over the different pairs; undetermined is not equal."""
    a, b = X.option_text(left), X.option_text(right)
    p = pairs.withColumn("_same", a == b)
    other = p.where(~F.col("_same")).select(left, right).distinct()

    def run(batches):
        import pyarrow as pa

        for x in batches:
            got = [expr.equivalent(u, v)[0] is True for u, v in zip(x.column(0).to_pylist(), x.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(got, pa.bool_())], names=[left, right, "_equal"])

    judged = other.mapInArrow(run, f"{left} string, {right} string, _equal boolean")
    j = p.join(judged.withColumnsRenamed({left: "_l", right: "_r"}), F.col(left).eqNullSafe(F.col("_l")) & F.col(right).eqNullSafe(F.col("_r")), "left")
    return j.withColumn("equal", F.col("_same") | F.coalesce("_equal", F.lit(False))).drop("_same", "_equal", "_l", "_r")


def mapped_options(printed: DataFrame, master: DataFrame, sheet: str, question: str, letters: list[str]) -> DataFrame:
    """(sheet, question, letter, issue): the printed letter of the master's correct option. ``printed`` has sheet, question, letter, text; ``master`` has
    question, letter, text, correct. Options count as the same if they are equal mathematically; a question is mapped only if its printed options are a
    permutation of the master's, each with one match and each match another one. Questions of the master that a sheet lacks are an issue, too."""
    m = master.select(question, F.col("letter").alias("m_letter"), F.coalesce("text", F.lit("")).alias("m_text"), "correct")
    none = F.upper(F.trim("text")) == "NONE"
    p = printed.where(F.col("letter").isin(letters)).select(sheet, question, F.col("letter").alias("p_letter"), F.when(none, "none of the above").otherwise(F.coalesce("text", F.lit(""))).alias("p_text")).distinct()
    texts = p.select(question, "p_text").distinct().join(m.select(question, "m_letter", "m_text"), question)  # a text once, however many sheets print it
    same = equal_texts(texts, "p_text", "m_text").where("equal").groupBy(question, "p_text").agg(F.collect_set("m_letter").alias("_m"))
    one = p.join(same.where(F.size("_m") == 1), [question, "p_text"], "left").select(sheet, question, "p_letter", F.get("_m", F.lit(0)).alias("m_letter"))
    correct = m.where("correct").select(question, F.col("m_letter").alias("_correct"))
    r = one.join(correct, question, "left").groupBy(sheet, question).agg(
        ((F.count_distinct("p_letter") == len(letters)) & (F.count_distinct("m_letter") == len(letters)) & (F.count("m_letter") == len(letters))).alias("_all"),
        F.min(F.when(F.col("m_letter") == F.col("_correct"), F.col("p_letter"))).alias("_letter"),
    )
    questions = [r[0] for r in m.select(question).distinct().collect()]  # of one exam: a few names
    every = printed.select(sheet).distinct().select(sheet, F.explode(F.array(*map(F.lit, questions)).cast(f"array<{m.schema[question].dataType.simpleString()}>")).alias(question))
    out = every.join(r, [sheet, question], "left")
    issue = F.when(F.col("_all").isNull(), "not on the printed pages").when(~F.col("_all"), "not a permutation of the master's options").when(F.col("_letter").isNull(), "no correct option")
    return out.select(sheet, question, F.when(issue.isNull(), F.col("_letter")).alias("letter"), issue.alias("issue"))


def choice_rubric(master: DataFrame, versions: DataFrame, question: str, version: str, points: float = 10.0) -> DataFrame:
    """Rubric rows of choice questions: per question the master's letter and that of each version. ``master`` has question, correct_letter; ``versions`` question, version, letter."""
    keys = versions.where("letter is not null").groupBy(question).agg(F.array_sort(F.collect_list(F.struct(F.col(version).alias("key"), F.col("letter").alias("value")))).alias("_k"))
    m = master.join(keys, question, "left")
    own = F.array(F.struct(F.lit("master").alias("key"), F.coalesce("correct_letter", F.lit("")).alias("value")))
    return m.select(question, F.lit(float(points)).alias("max_points"), F.lit("mcq").alias("kind"), F.map_from_entries(F.concat(own, F.coalesce("_k", F.slice(own, 1, 0)))).alias("mcq_keys"))


def _reason(*cases: tuple[Column, Column | str]) -> Column:
    return F.filter(F.array(*(F.when(c, F.lit(t) if isinstance(t, str) else t) for c, t in cases)), lambda x: x.isNotNull())


def graded_sheets(expected: DataFrame, rows: DataFrame, sheets: DataFrame, key: DataFrame, own: DataFrame, sheet: str, question: str, version: str) -> DataFrame:
    """One row per sheet and expected question with score, review and evidence.

    ``expected``: sheet, question, max_points. ``rows``: what was read of it, final_answer, needs_review, reasons (text). ``sheets``: sheet, version (null: not known).
    ``key``: version, question, letter, the approved one. ``own``: sheet, question, letter, by the options printed on the sheet itself. Without a key the score is null;
    a blank or wrong answer is 0. Whatever is missing or does not agree asks for review."""
    r = rows.select(sheet, question, F.col("final_answer").alias("answer"), F.coalesce("needs_review", F.lit(False)).alias("_review"), F.col("reasons").alias("_said"), F.lit(True).alias("_read"))
    k = key.select(version, question, F.col("letter").alias("key_letter"))
    o = own.select(sheet, question, F.col("letter").alias("own_key_letter")).distinct()
    j = expected.join(sheets.select(sheet, version).distinct(), sheet, "left").join(r, [sheet, question], "left").join(k, [version, question], "left").join(o, [sheet, question], "left")
    reasons = _reason(
        (F.col("_read").isNull(), "question not read"), (F.coalesce("_review", F.lit(False)), F.coalesce("_said", F.lit("reading doubtful"))), (F.col(version).isNull(), "version unknown"),
        (F.col(version).isNotNull() & F.col("key_letter").isNull(), "no approved key for the version"),
        (F.col("own_key_letter") != F.col("key_letter"), F.concat(F.lit("printed options give "), "own_key_letter", F.lit(", the key is "), "key_letter")),
    )
    right = F.coalesce(F.col("answer") == F.col("key_letter"), F.lit(False))
    score = F.when(F.col("key_letter").isNotNull(), F.when(right, F.col("max_points").cast("double")).otherwise(0.0))
    evidence = F.struct(F.col(version).alias("version"), "key_letter", "answer", "own_key_letter", F.col("_said").alias("reading"))
    return j.select(sheet, question, "max_points", score.alias("score"), evidence.alias("evidence"), (F.size(reasons) > 0).alias("needs_review"), F.array_join(reasons, "; ").alias("review_reasons"))


def hand_scores(marks: DataFrame, key: DataFrame, question: str, version: str, points: float = 10.0) -> DataFrame:
    """Adds ``reference`` to hand-read marks (sheet, version, question, mark): full points for the letter of the sheet's own version, else 0; null without a key."""
    k = key.select(version, question, F.col("letter").alias("_key"))
    j = marks.join(k, [version, question], "left")
    return j.withColumn("reference", F.when(F.col("_key").isNotNull(), F.when(F.coalesce(F.col("mark") == F.col("_key"), F.lit(False)), float(points)).otherwise(0.0))).drop("_key")


def full_rows(read: DataFrame, sheet: str, question: str, n: int) -> DataFrame:
    """Questions 1 to ``n`` of every sheet that was read: those that are not there come as ``omitted``, with no answer; of two rows for a question the last counts.
    ``read`` has sheet, question, letter and pos, the place of the row."""
    sheets = read.where(F.col(question).isNotNull()).select(sheet).distinct().select(sheet, F.explode(F.sequence(F.lit(1), F.lit(n))).alias(question))
    last = read.groupBy(sheet, question).agg(F.max(F.struct("pos", "letter")).alias("_l"))
    return sheets.join(last, [sheet, question], "left").select(sheet, question, F.col("_l.letter").alias("letter"), F.when(F.col("_l").isNull(), "omitted").otherwise("").alias("note"))
