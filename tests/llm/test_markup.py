import pytest

from gradeline.llm import markup as M


@pytest.mark.parametrize(
    "text, kind",
    [("a <p>b</p>", "html"), ("x<br>y", "html"), ("<!-- edge -->", "html"), ("a &nbsp; b", "entity"), ("a &#8211; b", "entity"), ("\\section{a}", "latex"), ("\\begin{itemize}\n\\item a\n\\end{itemize}", "latex"), ("\\(x\\)", "formula"), ("a \\\\\nb", "break"),
     ("```\nx\n```", "fence"), ("a `b` c", "code"), ("**a**", "bold"), ("__a__", "bold"), ("~~a~~", "strike"), ("## a", "heading"), ("* a", "item"), ("- a", "item"), ("> a", "quote"), ("| a | b |\n|---|---|", "table"), ("[a](#q1)", "link"), ("![a](b.png)", "link"), ("'''a'''", "wiki"), ("[[a|b]]", "wiki"), ("{{a|b}}", "wiki"), ("== a ==", "wiki")],
)
def test_found(text, kind):
    assert kind in M.kinds(text)


@pytest.mark.parametrize("text", ["", None, "a < b > c", "#3", "2 * 5 * 7", "P(A|B) | x", "[0,1]", "$\\frac{a}{b}$", "$$\\int x$$", "[[deleted: a\nb]]", "a & b", "$a<b$ c $d>e$", "x_1 + x_2", "a - b", "5 > 3"])
def test_not_found(text):
    assert M.kinds(text) == []


@pytest.mark.parametrize("f", ["", None, "\\frac{1}{2}", "\\begin{cases}a\\\\b\\end{cases}", "\\begin{pmatrix}1&2\\end{pmatrix}", "\\text{a}", "f''(x)+g''(y)", "a<b", "P(X|Y)=1", "x_{1}+x_{2}"])
def test_bare_formula(f):
    assert M.formula_kinds(f) == []


@pytest.mark.parametrize("f", ["$a$", "$$a$$", "\\(a\\)", "\\[a\\]", "<i>a</i>", "<math>a</math>", "a&nbsp;", "`a`", "**a**", "''a''", "```latex\na\n```", "\\begin{equation}a\\end{equation}", "\\label{e}a"])
def test_marked_formula(f):
    assert M.formula_kinds(f) and M.clean_formula(f) == "a"


@pytest.mark.parametrize(
    "text, out",
    [("<h2>T</h2><p>a</p>", "## T\n\na"), ("<ul><li>a</li><li>b</li></ul>", "- a\n\n- b"), ("<table><tr><td>a</td><td>b</td></tr></table>", "| a | b |"), ("<b>a</b> &amp; b", "a & b"), ("\\section{T}\na", "# T\n\na"), ("**a** _b_ ~~c~~ `d`", "a b c d"), ("\\[x\\] \\(y\\)", "$$x$$ $y$"),
     ("== T ==\n* a\n** b", "## T\n- a\n  - b"), ("[a](u.html) ![b](c.png)", "a b"), ("```\nx = **1**\n```", "```\nx = **1**\n```"), ("> $a*b$", "$a*b$"), ("[[x|y]] [[deleted: **q**]]", "y [[deleted: **q**]]"), ("\\begin{equation}a\\end{equation}", "$$a$$"),
     ("<b>x</b> \\frac{1}{2}", "x \\frac{1}{2}"), ("**a** \\sqrt{8} and \\binom{4}{2}", "a \\sqrt{8} and \\binom{4}{2}"), ("<pre><code>x *y* z</code></pre>", "```\nx *y* z\n```"), ("\\textbf{a \\emph{b}}", "a b"), ("\\textbf{a \\frac{1}{\\sqrt{2}}} b", "a \\frac{1}{\\sqrt{2}} b"),
     ("\\begin{tabular}{ll} a & b \\\\ c & d \\end{tabular}", "| a | b |\n| c | d |"), ("{| class=\"w\"\n! h !! i\n|-\n| a || b\n|}", "| h | i |\n| a | b |"), ("***a** b*", "a b"), ("_a b_ c_1", "a b c_1"), ("<code>a_b_c</code> &#42;x&#42; 2", "a_b_c *x* 2"), ("\\verb|x_*y*| \\noindent z 40\\% \\\\", "x_*y* z 40%"),
     ("<math>x<sub>1</sub></math>", "$x_{1}$"), ("a\n\n> b\n> c", "a\n\nb\nc"), ("\\begin{lstlisting}\na & b\n\\end{lstlisting}", "```\na & b\n```"), ("\\href{http://u}{t} \\footnote{n}", "t  (n)")],
)
def test_clean(text, out):
    assert M.clean(text) == out


def test_cleaning_again_changes_nothing():
    for text in ("<h2>T</h2><p>a <b>b</b> $x_1*y$</p>", "== T ==\n* a\n** b\n{{q|w}}", "\\section{T}\\textbf{a} \\(x\\)", "```\n<b>\n```\n**a**"):
        once = M.clean(text)
        assert M.clean(once) == once


def test_a_weak_mark_needs_another_page(spark):
    rows = [("a", "m", "v", "x\n| 5 |", None), ("b", "m", "v", "x *y z*", None), ("c", "n", "v", "*z* w", None), ("d", "n", "v", "plain", None)]
    df = spark.createDataFrame(rows, "transcript_id string, actual_model string, prompt_version string, interleaved_markdown string, math_latex array<string>")
    assert {r.transcript_id for r in M.found(df).collect()} == {"b", "c"}
    got = {r.transcript_id: r.clean_markdown for r in M.cleaned(df).collect()}
    assert got == {"a": "x\n| 5 |", "b": "x y z", "c": "z w", "d": "plain"}
    assert "SortMergeJoin" not in M.cleaned(df)._jdf.queryExecution().executedPlan().toString()


def test_hosts_vote_and_nothing_is_lost(spark):
    page = '<div class="nav7">menu</div><div class="body3"><h1>T</h1><p>{}</p></div>tail'
    rows = [(f"t{k}", "m", "v", page.format("word " * 20 + str(k)), None) for k in range(5)] + [("u", "m", "v", '<div class="other">' + "x " * 50 + "</div>", ["$a$", None, "b"]), ("n", None, None, None, None), ("e", "m", "v", "", []), ("p", "m", "v", "plain", ["b"])]
    df = spark.createDataFrame(rows, "transcript_id string, actual_model string, prompt_version string, interleaved_markdown string, math_latex array<string>").selectExpr("*", "1 as host", "2 as field")
    assert [r.body_path for r in M.winning_paths(df.drop("host")).collect()] == ["div.body#"]
    got = {r.transcript_id: r for r in M.cleaned(df.drop("host")).collect()}
    assert got["t0"].clean_markdown.startswith("# T\n\nword") and "menu" in got["t0"].clean_markdown and "tail" in got["t0"].clean_markdown
    assert got["u"].clean_latex == ["a", None, "b"] and got["n"].clean_markdown is None and got["e"].clean_markdown == "" and got["p"].clean_markdown == "plain"
    assert {(r.transcript_id, r.field) for r in M.found(df.drop("host")).collect()} == {*((f"t{k}", "interleaved_markdown") for k in range(5)), ("u", "interleaved_markdown"), ("u", "math_latex")}
    assert M.found(df.drop("host").limit(0)).count() == 0
    assert M.found(df).count() == 7
