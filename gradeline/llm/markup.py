"""Problem 5: markup of other formats in transcripts, found and turned into clean text.

Three steps. (1) Each page's HTML containers are scored by the visible text that they hold; marks that may as well be plain signs
(``WEAK``: a single star or underscore around words, a ruled line, a line between bars without a table's second line) are noted. (2) The pages of
a host, here the model and prompt that wrote them, vote in Spark on generalised paths, tag and class from the
outside in, indexes left out; the path with the most votes wins. A weak mark wins if ``AGREE`` pages have it. (3) Each page is read again: where it
has the winning path, that container is its body, and whatever stands outside is kept after it, not lost; weak marks that did not win stay text.
The body becomes text with headings (``#``), lists (``-``), tables (``|``), code fences and formulas in dollars. The cases are what this step took out.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut

#: Element names of HTML and of wiki extensions.
TAGS = """a abbr address article aside b big blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt em
figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark math meta nav
nowiki ol p pre q ref references s samp script section small span strike strong style sub summary sup table tbody td tfoot th thead title tr
tt u ul var video gallery poem syntaxhighlight source noinclude includeonly onlyinclude""".split()
#: LaTeX commands of formulas; outside of a formula they are bare mathematics, not text markup.
MATH = """frac dfrac tfrac binom sqrt int iint oint sum prod lim cdot cdots ldots dots times div pm mp leq le geq ge neq ne approx equiv sim simeq
to infty partial nabla in notin subset cup cap forall exists left right big Big text mathrm mathbb mathcal mathbf mathit operatorname overline
hat bar vec tilde alpha beta gamma delta epsilon varepsilon zeta eta theta vartheta iota kappa lambda mu nu xi pi rho varrho sigma tau upsilon
phi varphi chi psi omega Gamma Delta Theta Lambda Xi Pi Sigma Phi Psi Omega sin cos tan cot sec csc log ln exp min max arg det dim gcd Pr
mid quad qquad Rightarrow rightarrow Leftarrow leftarrow leftrightarrow implies iff land lor neg circ bullet star prime angle perp parallel
lfloor rfloor lceil rceil langle rangle square boxtimes checkmark not""".split()
_TAG = rf"""</?(?:{"|".join(sorted(TAGS, key=len, reverse=True))})(?:\s+[a-z][a-z0-9:_-]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s<>"'=]+))?)*\s*/?>"""
_COMMAND = rf"\\(?!(?:{'|'.join(MATH)})(?![a-zA-Z]))(?!begin(?![a-zA-Z]))(?!end(?![a-zA-Z]))[a-zA-Z]{{2,}}"
_ENV = r"\\(?:begin|end)\s*\{(?!(?:cases|d?cases|array|(?:small|[pbvBV])?matrix\*?)\})[^}\n]*\}"
#: name: pattern, for text outside of formulas.
RULES = {
    "html": rf"(?i){_TAG}|<!--|<!doctype\b|<(?:div|span|p|td|table|a|img|font)\s+[a-z-]+=[\"'][^<>]*\Z",
    "entity": r"&(?:[a-zA-Z][a-zA-Z0-9]{1,31}|#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6});",
    "latex": rf"{_COMMAND}|{_ENV}",
    "formula": r"\\[\[\]()]",
    "fence": r"(?m)^\s*(?:```|~~~)|```",
    "code": r"`[^`\n]+`",
    "bold": r"\*\*[^\s*](?:[^\n]*?[^\s])?\*\*|(?<!\w)__[^\s_](?:[^\n]*?[^\s])?__(?!\w)",
    "strike": r"~~[^\s~](?:[^\n]*?[^\s])?~~",
    "heading": r"(?m)^\s{0,3}#{1,6}[ \t]+\S",
    "item": r"(?m)^\s*(?:[-+]|\*{1,4})[ \t]+\S",
    "quote": r"(?m)^[ \t]{0,3}>[ \t]*\S",
    "rule": r"(?m)^\s{0,3}(?:-{3,}|\*{3,}|_{3,})\s*$",
    "table": r"(?m)^\s*\|?\s*:?-{2,}:?\s*\|[\s:|-]*$",
    "bars": r"(?m)^\s*\|[^\n]*\|\s*$",
    "link": r"!?\[[^\]\n]*\]\((?=[^)\n]*[/.#:])[^)\n]*\)|!\[[^\]\n]*\]\(",
    "wiki": r"(?m)'{2,5}[^'\n]+'{2,5}|\[\[(?!deleted:)[^\]\n]+\]\]|\{\{[^{}\n]+\}\}|\{\||\|\}|^\s*={2,6}[^=\n]+={2,6}\s*$|\[(?:https?|ftp)://",
    "emphasis": r"(?<![\w*])\*[^\s*][^*\n]*?(?<!\s)\*(?![\w*])|(?<![\w_\\])_[^\s_][^_\n]*?(?<!\s)_(?![\w_])",
}
#: A text without any of these has no match of the rule.
NEEDS = {
    "html": "<", "entity": "&", "latex": "\\", "formula": "\\", "break": "\\", "fence": ("```", "~~~"), "code": "`", "bold": ("**", "__"), "strike": "~~", "heading": "#",
    "quote": ">", "rule": ("---", "***", "___"), "table": "|", "bars": "|", "link": "](", "wiki": ("''", "[[", "{{", "{|", "|}", "==", "[http", "[ftp"), "emphasis": ("*", "_"),
}
RULES["break"] = r"\\\\"
IN_FORMULA = ("html", "entity", "latex", "formula", "fence", "code", "strike", "heading", "link")
#: Marks of a whole formula that is not bare.
WRAPPED = r"\$|\A\s*(?:''.*''|\*\*.*\*\*)\s*\Z"
FORMULA = re.compile(r"\$\$.+?\$\$|\$[^$\n]+\$", re.S)
DELETED = re.compile(r"\[\[deleted:.*?(?:\]\]|\Z)", re.I | re.S)
OPEN_FORMULA = re.compile(r"\$[^$\n]*$", re.M)
HOLD = "\ue000"
_P = {k: re.compile(v) for k, v in RULES.items()} | {"wrapped": re.compile(WRAPPED, re.S)}


def _has(name: str, text: str) -> bool:
    need = NEEDS.get(name, "")
    return (need in text if isinstance(need, str) else any(x in text for x in need)) and _P[name].search(text) is not None


def kinds(text: str | None) -> list[str]:
    """Kinds of markup in a transcript; its formulas in dollars and its deletion marks are none. Null and empty: none."""
    if not text:
        return []
    s = text
    if "[[" in s:
        s = DELETED.sub(HOLD, s)
    if "$" in s:
        s = OPEN_FORMULA.sub(HOLD, FORMULA.sub(HOLD, s))
    return [k for k in RULES if _has(k, s)]


def formula_kinds(entry: str | None) -> list[str]:
    """Kinds of markup in an entry that should be a bare formula."""
    if not entry:
        return []
    return [k for k in IN_FORMULA if _has(k, entry)] + ["wrapped"] * (_P["wrapped"].search(entry) is not None)


#: Marks that may be plain signs, the pages that must have one, and the most hosts whose winning paths are broadcast.
WEAK, AGREE, MOST_HOSTS = ("rule", "bars", "emphasis"), 2, 100_000
BLOCKS = {"p", "div", "section", "article", "blockquote", "table", "tr", "ul", "ol", "li", "pre", "main", "header", "footer", "nav", "aside", "center", "body", "html", "dl", "dt", "dd", "hr", "h1", "h2", "h3", "h4", "h5", "h6"}
HOSTS = {"div", "section", "article", "main", "body", "blockquote", "center"}
VOID = {"br", "hr", "img", "input", "meta", "link", "col", "source"}
_PART = re.compile(rf"(?is)(<!--.*?(?:-->|\Z)|<!doctype[^>]*>)|({_TAG})")
_NAME = re.compile(r"</?\s*([a-zA-Z0-9]+)")
_CLASS = re.compile(r"""(?i)\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_DIGITS = re.compile(r"\d+")


def containers(text: str) -> dict[str, tuple[int, int, int]]:
    """Per generalised path of a page's containers: visible characters, start and end of its first one's inside.
    The path is tag.class from the outside in; digits in a class count as one sign, so pages of a host agree."""
    out: dict[str, tuple[int, int, int]] = {}
    stack: list[tuple[str, str, int, int]] = []
    shown = last = 0
    for m in _PART.finditer(text):
        shown += len(text[last : m.start()].strip())
        last = m.end()
        if m.group(1):
            continue
        tag = m.group(2)
        name = _NAME.match(tag).group(1).lower()
        if tag.startswith("</"):
            while any(x[0] == name for x in stack):
                top, path, at, before = stack.pop()
                if top in HOSTS and path not in out:
                    out[path] = (shown - before, at, m.start())
                if top == name:
                    break
        elif name not in VOID and not tag.endswith("/>"):
            c = _CLASS.search(tag)
            cls = ".".join(sorted(_DIGITS.sub("#", next(filter(None, c.groups()), "")).split())) if c else ""
            stack.append((name, (stack[-1][1] + ">" if stack else "") + name + ("." + cls if cls else ""), m.end(), shown))
    return out


def _html(s: str) -> str:
    """Elements out; headings, lists, tables and line ends stay."""
    out: list[str] = []
    lists: list[str] = []
    last = 0
    for m in _PART.finditer(s):
        out.append(s[last : m.start()])
        last = m.end()
        if m.group(1):
            continue
        tag = m.group(2)
        name, end = _NAME.match(tag).group(1).lower(), tag.startswith("</")
        if re.fullmatch("h[1-6]", name):
            out.append("\n" if end else "\n" + "#" * int(name[1]) + " ")
        elif name in ("ul", "ol"):
            lists = lists[:-1] if end else [*lists, name]
            out.append("\n")
        elif name == "li":
            out.append("\n" if end else "\n" + "  " * max(0, len(lists) - 1) + "- ")
        elif name in ("td", "th"):
            out.append(" |" if end else " ")
        elif name == "tr":
            out.append("\n" if end else "\n|")
        elif name in ("sup", "sub"):
            out.append("}" if end else {"sup": "^{", "sub": "_{"}[name])
        elif name == "br" or name in BLOCKS:
            out.append("\n")
    out.append(s[last:])
    return "".join(out)


def _rows(rows: list[list[str]]) -> str:
    return "\n" + "\n".join("| " + " | ".join(" ".join(c.split()) for c in r) + " |" for r in rows if r) + "\n"


def _wiki_table(m: re.Match) -> str:
    rows: list[list[str]] = [[]]
    for line in m.group(1).split("\n")[1:]:
        line = line.strip()
        if line.startswith("|-"):
            rows.append([])
        elif line.startswith(("|+", "|}")):
            continue
        elif line[:1] in "|!" and line:
            for cell in re.split(r"\|\||!!" if line[0] == "!" else r"\|\|", line[1:]):
                rows[-1].append(re.sub(r"^\s*[a-z]+\s*=\s*(?:\"[^\"]*\"|\S+)[^|]*\|(?!\|)", "", cell))
        elif rows[-1]:
            rows[-1][-1] += " " + line
    return _rows(rows)


def _tabular(m: re.Match) -> str:
    body = re.sub(r"\\(?:hline|toprule|midrule|bottomrule|cline\{[^}]*\})", "", m.group(1))
    return _rows([re.split(r"(?<!\\)&", r) for r in re.split(r"\\\\(?:\[[^\]]*\])?", body) if r.strip()])


def _argument(s: str, at: int) -> int:
    """End of the group in braces that begins at ``at``, or ``at`` where none does or it has no end."""
    if s[at : at + 1] != "{":
        return at
    depth = 0
    for k in range(at, len(s)):
        depth += (s[k] == "{") - (s[k] == "}")
        if not depth:
            return k + 1
    return at


_MATH_NAME = re.compile(rf"\\(?:{'|'.join(MATH)})(?![a-zA-Z])")


def _hold_mathematics(s: str, put) -> str:
    """Bare formula commands with their arguments, held as they are."""
    out, last = [], 0
    for m in _MATH_NAME.finditer(s):
        if m.start() < last:
            continue
        end = m.end()
        while (after := _argument(s, end)) != end or s[end : end + 1] == "[" and "]" in s[end:]:
            end = after if after != end else s.index("]", end) + 1
        out += [s[last : m.start()], put(s[m.start() : end])]
        last = end
    return "".join([*out, s[last:]])


def _code(body: str, language: str = "") -> str:
    return f"\n```{language}\n" + body.strip("\n") + "\n```\n"


def _bare(s: str) -> str:
    return html.unescape(_PART.sub("", s))


_DISPLAY = r"(?:equation|align|gather|multline|displaymath|eqnarray|math)\*?"
#: Pieces that are taken out first, as their inside is no text: (pattern, what stays).
_HELD = [(re.compile(a), b) for a, b in [
    (r"(?is)\[\[deleted:.*?(?:\]\]|\Z)", lambda m: m.group(0)),
    (r"(?s)(?:```|~~~)[ \t]*(\w*)[ \t]*\n?(.*?)(?:```|~~~|\Z)", lambda m: _code(m.group(2), m.group(1))),
    (r"(?is)<(pre|syntaxhighlight)\b[^>]*>(.*?)</\1\s*>", lambda m: _code(_bare(m.group(2)))),
    (r"(?s)\\begin\s*\{(verbatim|lstlisting)\*?\}(?:\[[^\]]*\])?(.*?)\\end\s*\{\1\*?\}", lambda m: _code(m.group(2))),
    (r"(?<!`)`([^`\n]+)`(?!`)", lambda m: m.group(1)),
    (r"(?is)<(code|tt|kbd|samp)\b[^>]*>(.*?)</\1\s*>", lambda m: _bare(m.group(2))),
    (r"\\verb\*?([^a-zA-Z\s*])(.*?)\1", lambda m: m.group(2)),
    (r"(?s)\$\$.+?\$\$|\$[^$\n]+\$", lambda m: m.group(0)),
    (rf"(?s)\\begin\s*\{{({_DISPLAY})\}}(.*?)\\end\s*\{{\1\}}", lambda m: "$$" + re.sub(r"\\label\{[^{}]*\}", "", m.group(2)).strip() + "$$"),
    (r"(?s)\\\[(.*?)\\\]", lambda m: "$$" + m.group(1).strip() + "$$"),
    (r"(?s)\\\((.*?)\\\)", lambda m: "$" + m.group(1).strip() + "$"),
    (r"(?is)<math\b[^>]*>(.*?)</math\s*>", lambda m: "$" + html.unescape(_html(m.group(1))).strip() + "$"),
]]
_ENTITY = re.compile(RULES["entity"])
_STEPS = [(re.compile(a), b) for a, b in [
    (r"(?s)\\begin\s*\{tabular[x*]?\}(?:\{[^{}]*\}){1,2}(.*?)\\end\s*\{tabular[x*]?\}", _tabular),
    (r"(?s)(?<![^\n])(\{\|.*?)\n\|\}", _wiki_table),
    (r"\\(?:label|vspace|hspace|ref|cite|usepackage|documentclass|includegraphics|color)\*?(?:\[[^\]]*\])?\{[^{}]*\}", ""),
    (r"\\(?:begin|end)\s*\{[^{}]*\}(?:\[[^\]]*\])?", "\n"),
    (r"\\item(?![a-zA-Z])(?:\[[^\]]*\])?[ \t]*", "\n- "),
    (r"\\(?:newline|par|linebreak)(?![a-zA-Z])|\\\\", "\n"),
    (r"\\(?:noindent|centering|bigskip|medskip|smallskip|hline|maketitle|clearpage|newpage|bfseries|itshape|ttfamily|small|large|Large|huge|tiny|normalsize)(?![a-zA-Z])[ ]?", ""),
    (r"!?\[([^\]\n]*)\]\([^)\n]*\)", r"\1"),
    (r"\[(?:https?|ftp)://\S+\s+([^\]\n]+)\]", r"\1"),
    (r"\[\[(?:[^\]|\n]*\|)*([^\]|\n]+)\]\]", r"\1"),
    (r"(?m)^\s*={2}\s*([^=\n]+?)\s*={2}\s*$", r"## \1"),
    (r"(?m)^\s*={3,6}\s*([^=\n]+?)\s*={3,6}\s*$", r"### \1"),
    (r"(?m)^[ \t]*>[ \t]?", ""),
    (r"(?m)^[ \t]*\*{2,4}[ \t]+(?=\S)", "  - "),
    (r"(?m)^([ \t]*)[*+][ \t]+(?=\S)", r"\1- "),
    (r"(?m)^[ \t]{0,3}(?:-{3,}|\*{3,}|_{3,})[ \t]*$", ""),
]]
#: From the inside out, as often as one of them still finds something.
_NESTED = [(re.compile(a), b) for a, b in [
    (r"\\(?:chapter|section)\*?\{([^{}]*)\}", r"\n# \1\n"),
    (r"\\subsection\*?\{([^{}]*)\}", r"\n## \1\n"),
    (r"\\(?:subsubsection|paragraph|subparagraph)\*?\{([^{}]*)\}", r"\n### \1\n"),
    (r"\\footnote\{([^{}]*)\}", r" (\1)"),
    (r"\\href\{[^{}]*\}\{([^{}]*)\}", r"\1"),
    (r"\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}", r"\1"),
    (r"\{\{(?:[^{}|\n]*\|)*([^{}|\n]*)\}\}", r"\1"),
    (r"'{2,5}([^'\n]+)'{2,5}", r"\1"),
    (r"\*\*([^\s*](?:[^*\n]*[^\s*])?)\*\*", r"\1"),
    (r"(?<!\w)__([^\s_](?:[^\n]*?[^\s_])?)__(?!\w)", r"\1"),
    (r"~~([^\s~](?:[^~\n]*[^\s~])?)~~", r"\1"),
    (r"(?<![\w*])\*([^\s*](?:[^*\n]*?[^\s*])?)\*(?![\w*])", r"\1"),
    (r"(?<![\w_\\])_([^\s_](?:[^_\n]*?[^\s_])?)_(?![\w_])", r"\1"),
]]
_LAST = [(re.compile(a), b) for a, b in [(r"\\([%&#_{}])", r"\1"), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n")]]
_SLOT = re.compile("\ue000(\\d+)\ue001")


def clean(text: str, path: str | None = None) -> str:
    """Clean text of a page. With ``path`` the page's container of that path is the body; text outside of it follows.
    Code and formulas are taken out first and put back as they were; what encloses other text goes from the inside out."""
    if path:
        c = containers(text).get(path)
        if c:
            body, rest = text[c[1] : c[2]], text[: c[1]] + "\n" + text[c[2] :]
            return "\n".join(x for x in (clean(body), clean(rest)) if x)
    held: list[str] = []

    def put(piece: str) -> str:
        held.append(piece)
        return f"\ue000{len(held) - 1}\ue001"

    s = text.replace("\ue000", "").replace("\ue001", "")
    for pattern, stays in _HELD:
        s = pattern.sub(lambda m, f=stays: put(f(m)), s)
    s = _hold_mathematics(s, put)
    s = _html(s)
    s = _ENTITY.sub(lambda m: " " if not (x := html.unescape(m.group(0))).strip() else put(x), s)
    for step, to in _STEPS:
        s = step.sub(to, s)
    before = None
    while s != before:
        before = s
        for step, to in _NESTED:
            s = step.sub(to, s)
    for step, to in _LAST:
        s = step.sub(to, s)
    while _SLOT.search(s):
        s = _SLOT.sub(lambda m: held[int(m.group(1))], s)
    return re.sub(r"\n{3,}", "\n\n", s.replace("\xa0", " ")).strip()


def clean_formula(entry: str) -> str:
    """The bare formula of an entry."""
    s = re.sub(r"(?s)```\w*\n?|`", "", entry)
    s = html.unescape(_html(s))
    s = re.sub(r"\\(?:begin|end)\s*\{(?:equation|align|gather|multline|displaymath|math)\*?\}|\\[\[\]()]|\\label\{[^{}]*\}|\$|~~", "", s)
    return re.sub(r"\A\s*(''|\*\*)(.*)\1\s*\Z", r"\2", s, flags=re.S).replace("\xa0", " ").strip()


def host_of() -> Column:
    return F.concat_ws("|", F.coalesce("actual_model", F.lit("")), F.coalesce("prompt_version", F.lit("")))


def page_votes(text: str) -> list[tuple[str, int]]:
    """What a page votes for: its best container, the innermost that still holds nine tenths of the visible text of its containers (path, that
    text's length), and the weak marks on it (their names in angles, how often)."""
    out: list[tuple[str, int]] = []
    c = containers(text) if "<" in text else {}
    if c:
        most = max(v[0] for v in c.values())
        best = max((p for p, v in c.items() if v[0] >= 0.9 * most), key=lambda p: (p.count(">"), p))
        out.append((best, c[best][0]))
    return out + [(f"<{k}>", 1) for k in kinds(text) if k in WEAK]


def winning_paths(df: DataFrame) -> DataFrame:
    """(host, body_path, votes, marks): per host the container path that most of its pages with containers vote for, and the weak marks that
    ``AGREE`` pages, of the host or of all hosts together, have. A host without any vote has no row."""

    def run(batches):
        for b in batches:
            host, path, score = [], [], []
            for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for p, n in page_votes(t):
                    host.append(h), path.append(p), score.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(score, pa.int64())], names=["host", "path", "score"])

    pages = df.where("interleaved_markdown is not null").select(host_of().alias("host"), "interleaved_markdown")
    votes = cut(pages.mapInArrow(run, "host string, path string, score long").groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("score").alias("score")))
    weak = F.col("path").startswith("<")
    marks = [r.path[1:-1] for r in votes.where(weak).groupBy("path").agg(F.sum("votes").alias("v")).where(F.col("v") >= AGREE).orderBy("path").collect()]  # three names at most
    best = votes.groupBy("host").agg(F.max(F.when(~weak, F.struct("votes", "score", "path"))).alias("v"))
    return best.select("host", F.col("v.path").alias("body_path"), F.col("v.votes").alias("votes"), F.array(*map(F.lit, marks)).cast("array<string>").alias("marks"))


def extracted(text: str | None, path: str | None, marks: list[str] | None) -> tuple[str | None, list[str], str | None]:
    """A page read again: clean text, kinds of markup taken out, and the winning path if the page has it. Without markup it is unchanged."""
    k = [x for x in kinds(text) if x not in WEAK or x in (marks or ())]
    if not k:
        return text, k, None
    path = path if path and "html" in k and path in containers(text) else None
    return clean(text, path), k, path


def cleaned(df: DataFrame) -> DataFrame:
    """(transcript_id, host, body_path, markdown_kinds, latex_kinds, clean_markdown, clean_latex) of every row. A text without markup
    comes out as it is; null stays null; null entries of ``math_latex`` stay null. ``body_path`` is null where the page lacks it."""

    def run(batches):
        for b in batches:
            i, h, p, mk, lk, mt, lt = [], [], [], [], [], [], []
            for tid, host, path, marks, text, entries in zip(*(c.to_pylist() for c in b.columns)):
                e = [formula_kinds(x) for x in entries or []]
                t, k, used = extracted(text, path, marks)
                i.append(tid), h.append(host), p.append(used), mk.append(k), lk.append(sorted({y for x in e for y in x})), mt.append(t)
                lt.append(None if entries is None else [clean_formula(x) if y else x for x, y in zip(entries, e)])
            s, l = pa.string(), pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((i, s), (h, s), (p, s), (mk, l), (lk, l), (mt, s), (lt, l))], names=["transcript_id", "host", "body_path", "markdown_kinds", "latex_kinds", "clean_markdown", "clean_latex"])

    rows = df.select("transcript_id", host_of().alias("host"), "interleaved_markdown", "math_latex")
    won = cut(winning_paths(df))
    won = F.broadcast(won) if won.limit(MOST_HOSTS + 1).count() <= MOST_HOSTS else won
    rows = rows.join(won, "host", "left").select("transcript_id", "host", "body_path", "marks", "interleaved_markdown", "math_latex")
    return rows.mapInArrow(run, "transcript_id string, host string, body_path string, markdown_kinds array<string>, latex_kinds array<string>, clean_markdown string, clean_latex array<string>")


def found(df: DataFrame) -> DataFrame:
    """Fields from which reading again took markup out."""
    c = cleaned(df).select("transcript_id", F.explode(F.array(
        F.struct(F.lit("interleaved_markdown").alias("field"), F.size("markdown_kinds").alias("n")),
        F.struct(F.lit("math_latex").alias("field"), F.size("latex_kinds").alias("n")),
    )).alias("x"))
    return c.where("x.n > 0 and transcript_id is not null").select("transcript_id", "x.field").distinct()


def report(df: DataFrame) -> DataFrame:
    """Per host and kind of markup: records with it, and how many of them have the host's winning path."""
    c = cleaned(df).select("host", "transcript_id", "body_path", F.explode(F.array_union("markdown_kinds", "latex_kinds")).alias("kind")).distinct()
    return c.groupBy("host", "kind").agg(F.count("*").alias("n_records"), F.count("body_path").alias("n_on_path"), F.max("body_path").alias("body_path"))
