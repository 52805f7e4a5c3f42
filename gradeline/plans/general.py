"""Queries of operators whose own tables are not at hand, on tables of the same shape."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import scores as S, text as X
from ..operators import cohort, layout, store, votes
from .tables import Query, table

BANDS = [(-1000.0, 1500.0), (1500.0, 4500.0), (4000.0, 7000.0)]


def events(s, d):
    return table(s, d, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")


def page_parts(s, d):
    p = table(s, d, "part")
    return p.select("p_partkey", *(F.pmod(F.col("p_partkey") * k, F.lit(120)).cast("double").alias(n) for n, k in (("deskew", 7), ("crop", 11), ("contrast", 13), ("faint", 17), ("lighting", 19))))


PARTS_SQL = "parts AS (SELECT p_partkey, " + ", ".join(f"CAST((p_partkey * {k}) % 120 AS DOUBLE) AS {n}" for n, k in (("deskew", 7), ("crop", 11), ("contrast", 13), ("faint", 17), ("lighting", 19))) + " FROM part)"
SCORE_SQL = "round(0.30 * least(deskew, 100) + 0.20 * least(crop, 100) + 0.20 * least(contrast, 100) + 0.15 * least(faint, 100) + 0.15 * least(lighting, 100), 6)"


def fixing(s, d):
    return page_parts(s, d).select("p_partkey", F.round(S.fixing_score(*map(F.col, ("deskew", "crop", "contrast", "faint", "lighting"))), 6).alias("score"))


def grid_cells(s, d):
    """Line items as grid cells: an order is a sheet, a line a row of four boxes whose inks come from its numbers."""
    l = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.col("l_partkey")).alias("p"), F.min("l_suppkey").alias("k"))
    cells = l.select("l_orderkey", "l_linenumber", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"), "p", "k")
    return cells.select("l_orderkey", "l_linenumber", F.format_string("%d", "i").alias("letter"), (F.pmod(F.col("p") * (F.col("i") + 3), F.lit(97)) / 1000).alias("ink"), (F.pmod(F.col("k") * (F.col("i") + 5), F.lit(89)) / 100 + F.col("i") / 1000).alias("core_fill"))


CELLS_SQL = """l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_suppkey) AS k FROM lineitem GROUP BY ALL),
cells AS (SELECT l_orderkey, l_linenumber, CAST(i AS VARCHAR) AS letter, ((p * (i + 3)) % 97)::DOUBLE / 1000 AS ink, ((k * (i + 5)) % 89)::DOUBLE / 100 + i::DOUBLE / 1000 AS core_fill FROM l, range(4) t(i)),
low AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY ink) AS r, count(*) OVER (PARTITION BY l_orderkey) AS n FROM cells),
base AS (SELECT l_orderkey, median(ink) AS b FROM low WHERE r <= floor(n / 2) GROUP BY 1),
x AS (SELECT l_orderkey, l_linenumber, letter, core_fill, ink - b AS e FROM cells JOIN base USING (l_orderkey)),
y AS (SELECT l_orderkey, l_linenumber, bool_or(abs(e - 0.027) < 0.005) AS near, count(*) FILTER (WHERE e >= 0.027) AS n, max(core_fill) FILTER (WHERE e >= 0.027) - min(core_fill) FILTER (WHERE e >= 0.027) AS gap,
  arg_max(letter, core_fill) FILTER (WHERE e >= 0.027) AS dark, arg_min(letter, core_fill) FILTER (WHERE e >= 0.027) AS light FROM x GROUP BY ALL)"""

QUERIES: dict[str, Query] = {
    "column_range_join": Query(
        lambda s, d: layout.band_of(table(s, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", BANDS).select("c_custkey", "band"),
        "SELECT c_custkey, CASE WHEN c_acctbal BETWEEN -1000 AND 1500 THEN 0 WHEN c_acctbal BETWEEN 1500 AND 4500 THEN 1 WHEN c_acctbal BETWEEN 4000 AND 7000 THEN 2 ELSE 0 END AS band FROM customer",
    ),
    "asof_header": Query(
        lambda s, d: layout.backward_asof(events(s, d).where("event_type = 'purchase'").select("event_id", "user_id", "ts"), events(s, d).where("event_type = 'signup'").select("user_id", "ts", "event_id"), "user_id", "ts", "event_id", lambda t: F.date_trunc("day", t)).select("event_id", "user_id", F.col("last_value").alias("header_id")),
        """SELECT p.event_id, p.user_id, (SELECT arg_max(h.event_id, (h.ts, h.event_id)) FROM events h WHERE h.event_type = 'signup' AND h.user_id = p.user_id AND h.ts <= p.ts) AS header_id FROM events p WHERE p.event_type = 'purchase'""",
    ),
    "band_join": Query(
        lambda s, d: layout.within(
            events(s, d).where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("l_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("l_at")),
            events(s, d).where("event_type = 'click'").select("user_id", F.col("event_id").alias("r_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("r_at")), "user_id", "at", 3600,
        ).select("user_id", "l_id", "r_id"),
        "SELECT l.user_id, l.event_id AS l_id, r.event_id AS r_id FROM events l JOIN events r USING (user_id) WHERE l.event_type = 'purchase' AND r.event_type = 'click' AND abs(CAST(floor(epoch(l.ts)) AS BIGINT) - CAST(floor(epoch(r.ts)) AS BIGINT)) <= 3600",
    ),
    "running_budget": Query(
        lambda s, d: store.admitted(events(s, d).withColumn("cents", F.coalesce(F.round(F.col("value") * 100), F.lit(0.0)).cast("long")), "user_id", ["ts", "event_id"], "cents", 20000).select("event_id", "user_id", F.col("spent_before").cast("long").alias("spent_before"), "admitted"),
        """WITH e AS (SELECT event_id, user_id, ts, CAST(coalesce(round(value * 100), 0) AS BIGINT) AS cents FROM events), r AS (SELECT event_id, user_id, CAST(coalesce(sum(cents) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS spent_before FROM e)
        SELECT event_id, user_id, spent_before, spent_before < 20000 AS admitted FROM r""",
    ),
    "json_numbers": Query(
        lambda s, d: events(s, d).select("event_id", F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(0)).alias("k")),
        "SELECT event_id, coalesce(TRY_CAST(CAST(props AS JSON)->>'$.k' AS INTEGER), 0) AS k FROM events",
    ),
    "fixing_score": Query(fixing, f"WITH {PARTS_SQL} SELECT p_partkey, {SCORE_SQL} AS score FROM parts"),
    "worst_pages": Query(
        lambda s, d: fixing(s, d).orderBy(F.desc("score"), "p_partkey").limit(10),
        f"WITH {PARTS_SQL} SELECT p_partkey, {SCORE_SQL} AS score FROM parts ORDER BY score DESC, p_partkey LIMIT 10",
    ),
    "bbox_normalise": Query(
        lambda s, d: table(s, d, "part").select("p_partkey", S.box(*((F.pmod(F.col("p_partkey") * k, F.lit(64)) / 64) for k in (3, 5, 7, 11)), F.lit(640), F.lit(1280)).alias("b")).select("p_partkey", "b.x", "b.y", "b.w", "b.h"),
        """WITH f AS (SELECT p_partkey, (p_partkey * 3) % 64 AS a, (p_partkey * 5) % 64 AS b, (p_partkey * 7) % 64 AS c, (p_partkey * 11) % 64 AS e FROM part),
        g AS (SELECT p_partkey, least(a, c) * 10 AS x0, greatest(a, c) * 10 AS x1, least(b, e) * 20 AS y0, greatest(b, e) * 20 AS y1 FROM f)
        SELECT p_partkey, CAST(least(x0, 639) AS INTEGER) AS x, CAST(least(y0, 1279) AS INTEGER) AS y, CAST(least(greatest(x1 - least(x0, 639), 1), 640 - least(x0, 639)) AS INTEGER) AS w, CAST(least(greatest(y1 - least(y0, 1279), 1), 1280 - least(y0, 1279)) AS INTEGER) AS h FROM g""",
    ),
    "red_parts": Query(
        lambda s, d: table(s, d, "part").select("p_partkey", S.is_red(F.pmod(F.col("p_partkey") * 7919, F.lit(16777216)).cast("int")).alias("red")),
        "WITH c AS (SELECT p_partkey, (p_partkey * 7919) % 16777216 AS rgb FROM part) SELECT p_partkey, ((rgb >> 16) & 255) >= 192 AND ((rgb >> 8) & 255) <= 96 AND (rgb & 255) <= 96 AS red FROM c",
    ),
    "effective_dpi": Query(
        lambda s, d: table(s, d, "booklets").select("booklet_id", S.effective_dpi(F.transform("pages", lambda p: F.greatest(p["width"], p["height"]).cast("double")), F.lit(11.69), 300).alias("dpi")).distinct(),
        "SELECT DISTINCT booklet_id, CAST(CASE WHEN m IS NULL THEN 300 ELSE least(greatest(round(m / 11.69::DOUBLE), 72), 300) END AS INTEGER) AS dpi FROM (SELECT booklet_id, list_max(list_filter(list_transform(pages, lambda p: greatest(p.width, p.height)), lambda w: w >= 1000)) AS m FROM booklets)",
    ),
    "suit_tree": Query(
        lambda s, d: table(s, d, "part").select("p_partkey", S.suit(F.pmod("p_partkey", F.lit(10)) / 10, F.pmod("p_partkey", F.lit(2)), F.pmod(F.col("p_partkey") * 3, F.lit(20)) / 20, F.pmod(F.col("p_partkey") * 7, F.lit(50)) / 50).alias("suit")),
        """WITH f AS (SELECT p_partkey, (p_partkey % 10) / 10.0::DOUBLE AS ratio, p_partkey % 2 AS holes, (p_partkey * 3 % 20) / 20.0::DOUBLE AS top, (p_partkey * 7 % 50) / 50.0::DOUBLE AS solid FROM part)
        SELECT p_partkey, CASE WHEN (ratio < 0.7) = (holes >= 1) THEN CASE WHEN ratio < 0.7 THEN CASE WHEN top >= 0.45 THEN 'heart' ELSE 'diamond' END WHEN top >= 0.24 AND solid <= 0.82 THEN 'club' WHEN top < 0.24 AND solid > 0.82 THEN 'spade' END END AS suit FROM f""",
    ),
    "grid_rows": Query(
        lambda s, d: votes.resolved_rows(grid_cells(s, d), "l_orderkey", "l_linenumber"),
        f"""WITH {CELLS_SQL} SELECT l_orderkey, l_linenumber, CASE WHEN n = 0 THEN 'blank' WHEN n = 1 OR (n = 2 AND gap >= 0.08) THEN 'answered' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 OR (n = 2 AND gap >= 0.08) THEN light END AS answer,
          CASE WHEN n = 2 AND gap >= 0.08 THEN dark END AS cancelled, near OR (n = 2 AND gap >= 0.08 AND gap < 0.085) AS low_margin FROM y""",
    ),
    "option_bijection": Query(
        lambda s, d: votes.bijective(table(s, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus"), "l_orderkey", "l_returnflag", "l_linestatus", 2),
        "SELECT l_orderkey, count(*) = 2 AND count(DISTINCT l_returnflag) = 2 AND count(DISTINCT l_linestatus) = 2 AS bijective FROM (SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus FROM lineitem) GROUP BY 1",
    ),
    "tied_votes": Query(
        lambda s, d: votes.majority(table(s, d, "lineitem"), ["l_linestatus", "l_suppkey"], "l_returnflag"),
        """WITH n AS (SELECT l_linestatus, l_suppkey, l_returnflag, count(*) AS k FROM lineitem GROUP BY ALL), t AS (SELECT *, max(k) OVER (PARTITION BY l_linestatus, l_suppkey) AS top FROM n)
        SELECT l_linestatus, l_suppkey, CASE WHEN count(*) = 1 THEN min(l_returnflag) END AS l_returnflag, CASE WHEN count(*) = 1 THEN max(k) END AS support, CASE WHEN count(*) > 1 THEN 'tied' END AS unresolved FROM t WHERE k = top GROUP BY 1, 2""",
    ),
    "reading_order": Query(
        lambda s, d: layout.right_to_left(layout.reading_order(table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").distinct(), "l_orderkey", "l_partkey", "l_suppkey"), "l_orderkey", "reading_order").select("l_orderkey", "l_partkey", "l_suppkey", F.col("reading_order").cast("long"), F.col("rtl_index").cast("long")),
        """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey) - 1 AS reading_order, count(*) OVER (PARTITION BY l_orderkey) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem))
        SELECT l_orderkey, l_partkey, l_suppkey, reading_order, n - 1 - reading_order AS rtl_index FROM r""",
    ),
    "spans_right_to_left": Query(  # a line has the few spans of one order
        lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("l_partkey")).alias("k"), "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("t")))), lambda x: x["t"]), " ").alias("line")),
        "SELECT l_orderkey, string_agg(l_returnflag || l_linestatus, ' ' ORDER BY l_partkey DESC, l_linenumber, l_returnflag || l_linestatus) AS line FROM lineitem GROUP BY 1",
    ),
    "column_join": Query(  # regions of a page in the page's own columns: parts' prices in bands that differ by brand
        lambda s, d: layout.column_of(table(s, d, "part").select("p_partkey", "p_brand", "p_retailprice"), brand_bands(s, d), "p_brand", "p_retailprice").select("p_partkey", "column_index"),
        """WITH m AS (SELECT p_brand, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY 1)
        SELECT p_partkey, CASE WHEN p_retailprice BETWEEN lo AND (lo + hi) / 2 THEN 0 WHEN p_retailprice BETWEEN (lo + hi) / 2 AND hi - 1 THEN 1 ELSE 0 END AS column_index FROM part JOIN m USING (p_brand)""",
    ),
    "label_bands": Query(  # spans on a label's line between it and the label before: lines of an order by place and part
        lambda s, d: layout.band_rows(lines(s, d).where("n > 3").select("l_orderkey", F.col("n").alias("text"), "x", "y"), lines(s, d).where("n <= 3").select("l_orderkey", F.col("n").alias("label"), F.col("x").alias("lx"), F.col("y").alias("ly")), "l_orderkey").select("l_orderkey", "label", F.col("text").alias("span"), "x").distinct(),
        """WITH a AS (SELECT DISTINCT l_orderkey, l_linenumber AS n, l_partkey AS x, CAST(l_quantity AS BIGINT) AS y FROM lineitem), l AS (SELECT * FROM a WHERE n <= 3),
        b AS (SELECT l.l_orderkey, l.n, l.x, l.y, max(o.x) AS bound FROM l LEFT JOIN l o ON o.l_orderkey = l.l_orderkey AND abs(o.y - l.y) <= 6 AND o.x < l.x GROUP BY ALL)
        SELECT DISTINCT b.l_orderkey, b.n AS label, s.n AS span, s.x FROM b JOIN a s ON s.l_orderkey = b.l_orderkey AND s.n > 3 AND abs(s.y - b.y) <= 6 AND s.x < b.x AND (b.bound IS NULL OR s.x > b.bound)""",
    ),
    "numeric_ids": Query(
        lambda s, d: table(s, d, "orders").select(F.substring_index("o_orderpriority", "-", 1).alias("label"), "o_orderkey").select("o_orderkey", F.coalesce(F.trim("label").try_cast("int"), F.lit(0)).alias("n"), F.format_string("%02d", F.coalesce(F.trim("label").try_cast("int"), F.lit(0))).alias("padded")),
        "SELECT o_orderkey, coalesce(TRY_CAST(trim(split_part(o_orderpriority, '-', 1)) AS INTEGER), 0) AS n, printf('%02d', coalesce(TRY_CAST(trim(split_part(o_orderpriority, '-', 1)) AS INTEGER), 0)) AS padded FROM orders",
    ),
    "cosine_neighbours": Query(
        lambda s, d: cohort.cosine_neighbours(table(s, d, "embeddings"), "vec_id", "embedding", 0.4),
        """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 50 = 0)
        SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.v, e.v), 4) AS cosine FROM q JOIN e ON q.vec_id <> e.vec_id WHERE round(list_cosine_similarity(q.v, e.v), 4) >= 0.4""",
    ),
}


def brand_bands(s, d):
    m = table(s, d, "part").groupBy("p_brand").agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    half = (F.col("lo") + F.col("hi")) / 2
    return m.select("p_brand", F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.col("lo").alias("x0"), half.alias("x1")), F.struct(F.lit(1).alias("pos"), half.alias("x0"), (F.col("hi") - 1).alias("x1")))).alias("b")).select("p_brand", "b.*")


def lines(s, d):
    return table(s, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("x"), F.col("l_quantity").cast("long").alias("y")).distinct()


def drawn_pages(s, d):
    from ..operators import imaging

    return imaging.drawn(table(s, d, "booklets").select(F.regexp_extract("booklet_id", r"(\d+)", 1).cast("long").alias("id")).distinct())


def _imaging(name):
    def run(s, d):
        from ..operators import imaging

        return getattr(imaging, name)(drawn_pages(s, d))

    return run


def grid_answers(s, d):
    from ..operators import imaging

    return votes.resolved_rows(imaging.grid_cells(drawn_pages(s, d)), "path", "row")


def repaired(s, d):
    """Whole responses read by the repairing parser: how many top-level keys each has, null where it cannot be read."""
    import pyarrow as pa

    from ..functions import repair

    def run(batches):
        for b in batches:
            got = [repair.loads(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) if isinstance(x, dict) else None for x in got], pa.int32())], names=["id", "n_keys"])

    return table(s, d, "grades").select("id", "raw_response").distinct().mapInArrow(run, "id long, n_keys int")


def parsed_formulas(s, d):
    """Formula parse rate per model, measured by the parser."""
    import pyarrow as pa

    from ..functions import expr

    def run(batches):
        kept: dict[str, bool] = {}
        for b in batches:
            out = []
            for f in b.column(1).to_pylist():
                if f not in kept:
                    if len(kept) > 200_000:
                        kept.clear()
                    kept[f] = expr.parses(f)
                out.append(kept[f])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.bool_())], names=["actual_model", "parsed"])

    t = table(s, d, "transcriber").select("transcript_id", "actual_model", "math_latex", "interleaved_markdown").distinct()
    f = t.select("actual_model", F.explode(X.all_formulas("math_latex", "interleaved_markdown")).alias("formula"))
    r = f.mapInArrow(run, "actual_model string, parsed boolean")
    return r.groupBy("actual_model").agg(F.count("*").alias("total"), F.count_if("parsed").alias("parsed"), F.round(F.avg(F.col("parsed").cast("int")), 4).alias("parse_rate"))


def option_matches(s, d):
    """Expected expressions of a rubric's milestones that are mathematically equal to one of another path of the same question."""
    import pyarrow as pa

    from ..functions import expr

    r = table(s, d, "curated_rubric").where("kind = 'open'").distinct()
    p = r.select("rubric_id", "question_id", F.explode("paths").alias("p")).select("rubric_id", "question_id", F.col("p.path_id").alias("path_id"), F.explode("p.milestones").alias("m")).where("m.expected is not null")
    e = p.select("rubric_id", "question_id", "path_id", F.col("m.id").alias("milestone_id"), F.col("m.expected").alias("expected"))
    a, b = e.toDF("rubric_id", "question_id", "path_a", "m_a", "left"), e.toDF("rubric_id", "question_id", "path_b", "m_b", "right")

    def run(batches):
        for x in batches:
            got = [expr.equivalent(u, v) for u, v in zip(x.column(4).to_pylist(), x.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([*x.columns[:4], pa.array([g for g, _ in got], pa.bool_()), pa.array([h for _, h in got])], names=["rubric_id", "question_id", "m_a", "m_b", "equal", "how"])

    pairs = a.join(b, ["rubric_id", "question_id"]).where("path_a < path_b").select("rubric_id", "question_id", "m_a", "m_b", "left", "right")
    return pairs.mapInArrow(run, "rubric_id string, question_id string, m_a string, m_b string, equal boolean, how string")


def changes(s, d):
    from .transcripts import cer_pairs

    return cer_pairs(s, d).select("transcript_id", "before", "text")


def supplier_answers(s, d):
    """A supplier's first flag on each line number, as a person's answer to a question."""
    l = table(s, d, "lineitem")
    return l.groupBy(F.col("l_suppkey").alias("person"), F.col("l_linenumber").alias("question")).agg(F.min(F.struct("l_orderkey", "l_partkey", "l_returnflag"))["l_returnflag"].alias("letter"))


def formulas(s, d, shape: str):
    """Different formulas of a shape."""
    return table(s, d, "transcriber").select(F.explode("math_latex").alias("formula")).where(F.col("formula").rlike(shape)).distinct()


def per_formula(rows, fn, schema: str):
    """``fn`` of each formula, beside it, in an Arrow pass."""
    import pyarrow as pa

    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for b in batches:
            cols = list(zip(*map(fn, b.column(0).to_pylist()))) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c)) for c in cols)], names=["formula", *names]) if b.num_rows else pa.RecordBatch.from_pydict({n: [] for n in ["formula", *names]})

    return rows.mapInArrow(run, "formula string, " + schema)


#: Shapes of formulas that SQL can work out as well: products, quotients, roots, sums of powers' bounds, binomials.
NUM = r"([0-9]+(?:\.[0-9]+)?)"
PRODUCT = rf"^{NUM}\\cdot{NUM}={NUM}$"
FRACTION = rf"^\\(?:theta|mu|lambda|alpha|beta|rho|sigma|varphi)=\\frac\{{{NUM}\}}\{{{NUM}\}}$"
ROOT = rf"^\\(?:theta|mu|lambda|alpha|beta|rho|sigma|varphi)=\\sqrt\{{{NUM}\}}$"
POWER = rf"^\\binom\{{([0-9]+)\}}\{{([0-9]+)\}}{NUM}\^\{{([0-9]+)\}}$"


def formula_values(s, d):
    """Values of formulas by the expression engine: an equation is the difference of its sides, a name counts 0."""
    from ..functions import expr

    def value(f):
        tree = expr.parse(f)
        v = None if tree is None else expr.number(tree, {n: 0.0 for n in expr.names(tree)})
        return (None if v is None else v.real, ",".join(sorted(expr.names(tree))) if tree else None)

    got = per_formula(formulas(s, d, "|".join((PRODUCT, FRACTION, ROOT, POWER))), value, "value double, names string")
    # as sign and magnitude, since a power may be of any size and a logarithm is never half way between two roundings
    return got.select("formula", F.signum("value").cast("int").alias("sign"), F.when(F.col("value") != 0, F.round(F.log10(F.abs("value")), 6) + F.lit(0.0)).alias("magnitude"), "names")


def product_checks(s, d):
    """Products as respondents write them: the number written behind the sign, its decimals, and whether it is the product by the rule of scoring."""
    from ..functions import expr
    from ..operators import scoring

    def check(f):
        said = scoring.written(f)
        target = expr.evaluate(f.rsplit("=", 1)[0], {})
        return said.value, said.decimals, said.is_about(target)

    return per_formula(formulas(s, d, PRODUCT), check, "value double, decimals long, right boolean")


def content_hashes(s, d):
    """Hash of a question's canonical JSON: keys in order, as the proposals of a rubric are told apart."""
    import pyarrow as pa

    from ..functions import repair

    def run(batches):
        import hashlib

        for b in batches:
            out = [hashlib.sha256(repair.canonical({"rubric_id": r, "question_id": q, "max_points": m, "kind": k}).encode()).hexdigest()[:16] for r, q, m, k in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["rubric_id", "question_id", "content_hash"])

    return table(s, d, "curated_rubric").select("rubric_id", "question_id", "max_points", "kind").distinct().mapInArrow(run, "rubric_id string, question_id string, content_hash string")


_F_SQL = "f AS (SELECT DISTINCT formula FROM (SELECT unnest(math_latex) AS formula FROM transcriber) WHERE {where})"
_PART = lambda p, k: f"CAST(regexp_extract(formula, '{p}', {k}) AS DOUBLE)"
QUERIES |= {
    "formula_values": Query(
        formula_values,
        "WITH " + _F_SQL.format(where=" OR ".join(f"regexp_matches(formula, '{p}')" for p in (PRODUCT, FRACTION, ROOT, POWER))) + rf"""
        , v AS (SELECT formula, CASE WHEN regexp_matches(formula, '{PRODUCT}') THEN {_PART(PRODUCT, 1)} * {_PART(PRODUCT, 2)} - {_PART(PRODUCT, 3)} WHEN regexp_matches(formula, '{FRACTION}') THEN -{_PART(FRACTION, 1)} / {_PART(FRACTION, 2)}
          WHEN regexp_matches(formula, '{ROOT}') THEN -sqrt({_PART(ROOT, 1)}) WHEN {_PART(POWER, 1)} < {_PART(POWER, 2)} THEN 0.0::DOUBLE ELSE round(gamma({_PART(POWER, 1)} + 1) / gamma({_PART(POWER, 2)} + 1) / gamma({_PART(POWER, 1)} - {_PART(POWER, 2)} + 1)) * pow({_PART(POWER, 3)}, {_PART(POWER, 4)}) END AS v FROM f)
        SELECT formula, CAST(sign(v) AS INTEGER) AS sign, CASE WHEN v <> 0 THEN round(log10(abs(v)), 6) + 0.0 END AS magnitude, coalesce(regexp_extract(formula, '^\\(theta|mu|lambda|alpha|beta|rho|sigma|varphi)=', 1), '') AS names FROM v""",
    ),
    "product_checks": Query(
        product_checks,
        "WITH " + _F_SQL.format(where=f"regexp_matches(formula, '{PRODUCT}')") + rf""", v AS (SELECT formula, {_PART(PRODUCT, 3)} AS value, {_PART(PRODUCT, 1)} * {_PART(PRODUCT, 2)} AS target, nullif(length(regexp_extract(regexp_extract(formula, '{PRODUCT}', 3), '\.([0-9]+)', 1)), 0) AS decimals FROM f),
        g AS (SELECT *, greatest(abs(value), abs(target), 1e-12) AS scale, abs(value - target) AS gap FROM v)
        SELECT formula, value, decimals, gap <= 1e-6 * scale OR (decimals IS NOT NULL AND gap <= 0.5 * pow(10.0::DOUBLE, -decimals) + 1e-12 AND gap <= 0.01 * scale) AS "right" FROM g""",
    ),
    "content_hashes": Query(
        content_hashes,
        """SELECT DISTINCT rubric_id, question_id, substr(sha256('{"kind": ' || to_json(kind) || ', "max_points": ' || max_points || ', "question_id": ' || to_json(question_id) || ', "rubric_id": ' || to_json(rubric_id) || '}'), 1, 16) AS content_hash FROM curated_rubric""",
    ),
}
QUERIES |= {
    "page_measures": Query(_imaging("measured")),
    "page_regions": Query(_imaging("regions")),
    "page_tables": Query(_imaging("tables")),
    "page_columns": Query(_imaging("columns")),
    "page_grid_answers": Query(grid_answers),
    "json_repair": Query(repaired),
    "parsed_formulas": Query(parsed_formulas),
    "expression_matches": Query(option_matches),
    "shared_anomalies": Query(  # suppliers next to each other; N is the right answer
        lambda s, d: cohort.shared_anomalies(
            supplier_answers(s, d).select(F.col("person").alias("a"), (F.col("person") + 1).alias("b")).distinct(), supplier_answers(s, d), "person", "question", "letter",
            supplier_answers(s, d).select("question", F.lit("N").alias("letter")).distinct(),
        ).withColumn("score", F.round("score", 6)),
        """WITH x AS (SELECT l_suppkey AS person, l_linenumber AS question, min((l_orderkey, l_partkey, l_returnflag)) AS m FROM lineitem GROUP BY ALL), y AS (SELECT person, question, m[3] AS letter FROM x),
        n AS (SELECT question, count(*) AS n FROM y GROUP BY 1), w AS (SELECT * FROM y WHERE letter <> 'N'), v AS (SELECT question, letter, ln(any_value(n)::DOUBLE / count(*)) AS w FROM w JOIN n USING (question) GROUP BY ALL)
        SELECT p.person AS a, q.person AS b, count(*) AS n_shared, round(sum(v.w), 6) AS score FROM w p JOIN w q ON q.person = p.person + 1 AND q.question = p.question AND q.letter = p.letter JOIN v ON v.question = p.question AND v.letter = p.letter GROUP BY ALL""",
    ),
    "pending_jobs": Query(  # transcriptions still to do: crops of each model without a reading free of errors
        lambda s, d: store.pending(table(s, d, "transcriber").select("crop_id", "model"), table(s, d, "transcriber").where(F.size("errors") == 0).select("crop_id", "model"), ["crop_id", "model"]),
        "SELECT DISTINCT crop_id, model FROM transcriber t WHERE NOT EXISTS (SELECT 1 FROM transcriber o WHERE o.crop_id = t.crop_id AND o.model = t.model AND len(o.errors) = 0)",
    ),
    "enough_examinees": Query(
        lambda s, d: cohort.enough_for_item_response(table(s, d, "grades"), "rubric_id", "booklet_id"),
        "SELECT rubric_id, count(DISTINCT booklet_id) AS n_persons, count(DISTINCT booklet_id) >= 100 AS enough FROM grades GROUP BY 1",
    ),
    "reading_changes": Query(  # how far a crop's reading went from the one before, in words
        lambda s, d: cohort.derivations(changes(s, d), "before", "text").select("transcript_id", "edits", "common", F.round("kept", 6).alias("kept")),
    ),
    "vector_clusters": Query(lambda s, d: cohort.clustered(table(s, d, "embeddings"), "vec_id", "embedding", 8)[1]),
}
