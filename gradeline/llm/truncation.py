"""Problem 1: texts of which only the beginning was kept.

Whether a text was cut is decided from its length and from its ending, each used once.

Length. Per source, lengths follow a log-normal distribution that field limits censor from the right. Every length, in characters
and in bytes of UTF-8, is a candidate limit; what counts there are different texts, as one message said a hundred times is no limit. The
distribution is fitted by maximum likelihood (EM over a histogram of bounded size per source, the surplus of texts at a length counted
as censored there). It gives the number of whole texts to expect at exactly that length; what stands there beyond that number,
``SIGMAS`` standard deviations of it and one text was cut there, and its share of the texts there is the censoring posterior by length.
Off the limits texts are cut in mid-transfer, at the rate of the *other* texts of their source that stand off the limits.

Ending. A cut falls behind any character. So the likelihood ratios of an ending are

* open (the format's last key, closing brackets or full stop is missing, whatever was put at the end instead): 1 / ``EXCEPTION``, the share
  of whole responses that lack the end that their format prescribes;
* a plain text with a full stop at its end: the share of full stops among its characters, the chance that a cut falls behind one;
* closed JSON: the chance that words stood behind it and the cut fell just there: their rate in the source over the characters.

The posterior odds are the odds by length times that ratio. So a text that ends with a full stop at a limit at which most others were
cut is found, a whole response of that length is not, and one open text among thousands of whole ones is found.

Null, empty and blank texts are no case. A record delivered twice is one record; of one with several texts each is judged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut

#: How the formats of the project end.
OPEN_END = r'(?s)"undeclared_method"\s*:.*"reaches_correct_conclusion"\s*:\s*(?:null|true|false)\s*\}\s*\}'
GRID_END = r'(?s)"rows"\s*:.*\}\s*\]\s*\}'
TRANSCRIPT_END = r'"transcription_confidence"\s*:\s*(?:null|-?[0-9][0-9.eE+-]*)\s*\}'
#: An object begins somewhere in the text.
JSON_START = r'\{\s*(?:"|\z)'
#: Notes that whoever cut a text puts at its end.
CUT_NOTE = r"(?i)(?:…|\.\.\.|\[[^\]\n{}\",:]{0,20}\]|<(?:snip|cut|truncated|more)>|\((?:truncated|cut|continued)\))\s*$"
#: Share of whole responses without the end of their format: by the definition of the formats none; one in a million is granted.
EXCEPTION = 1e-6
#: Sampling error granted to the number of whole texts at a length, in standard deviations.
SIGMAS = 3.0
#: Lengths to either side that show how many texts to expect at a length, besides the fitted distribution.
AROUND = 40
#: Histogram bins per doubling of length.
BINS = 24


def ending(text: Column) -> Column:
    """closed_json, words (closed JSON with something behind it), closed_plain or open."""
    closed = text.rlike(OPEN_END) | (text.contains('"rows"') & ~text.contains('"path_followed"') & text.rlike(GRID_END)) | text.rlike(TRANSCRIPT_END)
    last = F.regexp_replace(text, r"\s+\z", "")
    return (
        F.when(text.rlike(JSON_START), F.when(~closed, "open").when(last.rlike(r"[}`]\z"), "closed_json").otherwise("words"))
        .when(last.endswith(".") & ~last.rlike(CUT_NOTE), "closed_plain").otherwise("open")
    )


def texts(grades: DataFrame, transcriber: DataFrame) -> DataFrame:
    """(source_table, record_id, source, text); empty, blank and null texts are left out."""
    g = grades.select(F.lit("grades").alias("source_table"), F.col("id").cast("string").alias("record_id"), F.col("provider_model").alias("source"), F.col("raw_response").alias("text"))
    t = transcriber.select(F.lit("transcriber").alias("source_table"), F.col("transcript_id").alias("record_id"), F.col("actual_model").alias("source"), F.col("raw_text").alias("text"))
    return g.unionByName(t).where("record_id is not null and text is not null").where(~F.col("text").rlike(r"^\s*$"))


def measured(records: DataFrame) -> DataFrame:
    """(source_table, record_id, source, chars, bytes, dots, h, ending), texts left behind, repeated deliveries once; ``h`` is the text's hash."""
    t = F.col("text")
    dots = F.length(t) - F.length(F.replace(t, F.lit(".")))
    return records.select(
        "source_table", "record_id", F.coalesce("source", F.lit("")).alias("source"), F.length(t).cast("long").alias("chars"), F.octet_length(t).cast("long").alias("bytes"), dots.alias("dots"), F.xxhash64(t).alias("h"), ending(t).alias("ending"),
    ).distinct()


def histogram(m: DataFrame) -> DataFrame:
    """(source_table, source, unit, at, n_at, around): different texts of each length, and the mean of the lengths up to about AROUND away."""
    long = m.select("source_table", "source", "h", F.explode(F.map_from_arrays(F.array(F.lit("chars"), F.lit("bytes")), F.array("chars", "bytes"))).alias("unit", "at")).distinct()
    h = long.groupBy("source_table", "source", "unit", "at").agg(F.count("*").alias("n_at"))
    # sums of the three coarse cells around a length
    key, cell = ["source_table", "source", "unit"], F.floor(F.col("at") / AROUND)
    cells = h.groupBy(*key, cell.alias("cell")).agg(F.sum("n_at").alias("n_cell"))
    near = cells.select(*key, F.explode(F.array(*(F.col("cell") + k for k in (-1, 0, 1)))).alias("cell"), "n_cell").groupBy(*key, "cell").agg(F.sum("n_cell").alias("n"))
    around = h.withColumn("cell", cell).join(near, [*key, "cell"])
    return around.select(*key, "at", "n_at", ((F.col("n") - F.col("n_at")) / (3 * AROUND - 1)).alias("around"))


def surplus(n_at: Column, expected: Column) -> Column:
    """Texts at a length beyond those expected, their sampling error and one."""
    return F.greatest(n_at - expected - SIGMAS * F.sqrt(expected) - 1, F.lit(0.0))


def _phi(z):
    return math.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def _tail(z):
    return max(0.5 * math.erfc(z / math.sqrt(2)), 1e-300)


def fit(bins: list[tuple[float, float]], censored: list[tuple[float, float]], rounds: int = 200) -> tuple[float, float]:
    """Mean and deviation of log length by EM: ``bins`` of (log length, texts), ``censored`` of (log limit, texts cut there)."""
    n = sum(k for _, k in bins) + sum(k for _, k in censored)
    s = sum(x * k for x, k in bins)
    q = sum(x * x * k for x, k in bins)
    mu = (s + sum(x * k for x, k in censored)) / n
    sd = max(math.sqrt(max((q + sum(x * x * k for x, k in censored)) / n - mu * mu, 0)), 1e-3)
    for _ in range(rounds):
        es, eq = s, q
        for x, k in censored:
            z = (x - mu) / sd
            hazard = _phi(z) / _tail(z)
            es += k * (mu + sd * hazard)
            eq += k * (mu * mu + sd * sd + sd * (x + mu) * hazard)
        new = es / n
        dev = max(math.sqrt(max(eq / n - new * new, 0)), 1e-3)
        done = abs(new - mu) + abs(dev - sd) < 1e-7
        mu, sd = new, dev
        if done:
            break
    return mu, sd


def _fit_source(pdf):
    import pandas as pd

    first = pdf.iloc[0]
    free = pdf["at"].isna()
    mu, sd = fit(
        [*zip(pdf["x"][free], pdf["n"][free]), *((x, n - k) for x, n, k in zip(pdf["x"][~free], pdf["n"][~free], pdf["censored"][~free]))],
        list(zip(pdf["x"][~free], pdf["censored"][~free])),
    )
    total = pdf["n"].sum()
    out = [(first["source_table"], first["source"], first["unit"], None, mu, sd, None, None, None)]
    for z, n, near in zip(pdf["at"][~free], pdf["n"][~free], pdf["around"][~free]):
        whole = total * max(_tail((math.log(z) - mu) / sd) - _tail((math.log(z + 1) - mu) / sd), 0.0)
        expected = max(whole, near)
        cut_there = max(n - expected - SIGMAS * math.sqrt(expected) - 1, 0.0)
        out.append((first["source_table"], first["source"], first["unit"], int(z), mu, sd, float(n), expected, cut_there / n))
    return pd.DataFrame(out, columns=["source_table", "source", "unit", "at", "mu", "sd", "n_at", "expected", "p"])


def censoring(m: DataFrame) -> DataFrame:
    """Fitted distributions: a row per source and unit (``at`` null), and one per length with a surplus: the number of different texts there, of
    whole ones expected, and the share ``p`` of cut ones. Input per source: a row per length bin and such length, whatever the source's size."""
    h = histogram(m).withColumn("censored", surplus(F.col("n_at"), F.col("around")))
    alone = F.col("censored") > 0
    bins = h.groupBy("source_table", "source", "unit", F.when(alone, F.col("at")).alias("at"), F.when(~alone, F.floor(F.log2("at") * BINS)).alias("bin")).agg(
        (F.sum(F.log("at") * F.col("n_at")) / F.sum("n_at")).alias("x"), F.sum("n_at").cast("double").alias("n"), F.sum("censored").alias("censored"), F.max("around").alias("around")
    )
    out = "source_table string, source string, unit string, at long, mu double, sd double, n_at double, expected double, p double"
    return bins.groupBy("source_table", "source", "unit").applyInPandas(_fit_source, out)


def scored(m: DataFrame) -> DataFrame:
    """Adds ``at_limit`` (more likely cut than not by its length), ``prior`` by length and ``posterior`` that the text was cut."""
    c = censoring(m).where("p > 0").select("source_table", "source", "unit", "at", "p")
    by = lambda unit, name: c.where(F.col("unit") == unit).select("source_table", "source", F.col("at").alias(unit), F.col("p").alias(name))
    s = m.join(by("chars", "pc"), ["source_table", "source", "chars"], "left").join(by("bytes", "pb"), ["source_table", "source", "bytes"], "left")
    s = s.withColumn("p", F.greatest(F.coalesce("pc", F.lit(0.0)), F.coalesce("pb", F.lit(0.0)))).withColumn("at_limit", F.col("p") >= 0.5).withColumn("open", (F.col("ending") == "open").cast("int"))
    s = cut(s)
    off = ~F.col("at_limit")
    rates = s.groupBy("source_table", "source").agg(
        F.count_if(off).alias("n_off"), F.sum(F.when(off, F.col("open")).otherwise(0)).alias("n_open"),
        F.count_if(F.col("ending") == "words").alias("n_words"), F.count_if(F.col("ending").isin("words", "closed_json")).alias("n_json"),
    )
    s = s.join(rates, ["source_table", "source"])
    own = off.cast("int")  # the text itself has no part in its prior
    rate = (F.col("n_open") - own * F.col("open") + 0.5) / (F.col("n_off") - own + 1)
    prior = F.least(F.greatest(1 - (1 - F.col("p")) * (1 - rate), F.lit(1e-12)), F.lit(1 - 1e-9))
    behind = (F.col("n_words") + 0.5) / (F.col("n_json") + 1) / F.col("chars")
    ratio = F.when(F.col("open") == 1, 1 / EXCEPTION).when(F.col("ending") == "closed_plain", F.col("dots") / F.col("chars")).otherwise(behind)
    odds = prior / (1 - prior) * ratio
    return s.withColumn("prior", prior).withColumn("posterior", odds / (1 + odds))


def found(grades: DataFrame, transcriber: DataFrame) -> DataFrame:
    return scored(cut(measured(texts(grades, transcriber)))).where("posterior >= 0.5").select("source_table", "record_id").distinct()


def report(grades: DataFrame, transcriber: DataFrame) -> DataFrame:
    """Per source: different texts of its records, cut ones and their share."""
    s = scored(cut(measured(texts(grades, transcriber))))
    is_cut = F.col("posterior") >= 0.5
    return s.groupBy("source_table", "source").agg(F.count("*").alias("n_records"), F.count_if(is_cut).alias("n_cut"), F.avg(is_cut.cast("int")).alias("cut_share"))


def limits(grades: DataFrame, transcriber: DataFrame) -> DataFrame:
    """Per source and unit the fitted length distribution, and each length at which more texts were cut than not."""
    return censoring(cut(measured(texts(grades, transcriber)))).where("at is null or p >= 0.5")
