"""SQL with the same rows for the operators that SQL can express on whole tables."""

from __future__ import annotations

import unicodedata as ud

from . import looks as L, markup as M

#: Written from the definition of the cases: a response is whole if the last part of its format stands complete, a plain text if it ends with a full stop.
_P1 = r"""
WITH r AS (
  SELECT 'grades' AS source_table, CAST(id AS VARCHAR) AS record_id, coalesce(provider_model, '') AS source, raw_response AS t FROM grades
  UNION SELECT 'transcriber', transcript_id, coalesce(actual_model, ''), raw_text FROM transcriber
), x AS (SELECT *, rtrim(t, chr(10) || chr(9) || chr(13) || ' ') AS s FROM r WHERE t IS NOT NULL AND record_id IS NOT NULL AND trim(t, chr(10) || chr(9) || chr(13) || ' ') <> ''),
k AS (SELECT *, CASE
    WHEN NOT regexp_matches(t, '\{\s*("|$)') THEN NOT ends_with(s, '.') OR ends_with(s, '...')
    WHEN contains(t, '"path_followed"') THEN NOT regexp_matches(t, '(?s)"undeclared_method": ?\{.*"reaches_correct_conclusion": ?(null|true|false)\s*\}\s*\}')
    WHEN contains(t, '"rows"') THEN NOT regexp_matches(t, '(?s)\}\s*\]\s*\}')
    ELSE NOT regexp_matches(t, '"transcription_confidence": ?(null|[0-9.]+)\s*\}') END AS is_cut FROM x)"""
P1_FOUND = _P1 + " SELECT DISTINCT source_table, record_id FROM k WHERE is_cut"
P1_RATES = _P1 + " SELECT source_table, source, count(*) AS n_records, count_if(is_cut)::BIGINT AS n_cut, avg(is_cut::INT)::DOUBLE AS cut_share FROM k GROUP BY ALL"

_SHARES = r"""
WITH d AS (SELECT DISTINCT doc_id, lang, source, text FROM documents),
s AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\s+')) AS w, generate_subscripts(regexp_split_to_array(coalesce(text, ''), '\s+'), 1) AS i FROM d),
w AS (SELECT doc_id, lower(regexp_replace(w, '^\p{P}+|\p{P}+$', '', 'g')) AS w, i FROM s),
n AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM w WHERE w <> ''),
g AS (SELECT doc_id, p, w || chr(1) || lead(w, 1) OVER o || chr(1) || lead(w, 2) OVER o || chr(1) || lead(w, 3) OVER o AS g FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
f AS (SELECT doc_id, p, min(p) OVER (PARTITION BY doc_id, g) AS first FROM g WHERE g IS NOT NULL),
m AS (SELECT DISTINCT doc_id, p + k AS p FROM f, range(4) t(k) WHERE p > first),
r AS (SELECT doc_id, count(*) AS n_repeated FROM m GROUP BY 1), c AS (SELECT doc_id, count(*) AS n_words FROM n GROUP BY 1),
shares AS (SELECT d.doc_id, d.lang, d.source, coalesce(n_words, 0) AS n_words, coalesce(n_repeated, 0) AS n_repeated, CASE WHEN coalesce(n_words, 0) > 0 THEN coalesce(n_repeated, 0)::DOUBLE / n_words ELSE 0.0::DOUBLE END AS share
  FROM (SELECT DISTINCT doc_id, lang, source FROM d) d LEFT JOIN c USING (doc_id) LEFT JOIN r USING (doc_id))"""
P8_SHARES = _SHARES + " SELECT * FROM shares"
P8_FOUND = _SHARES + " SELECT DISTINCT doc_id FROM shares WHERE share >= 0.3"




def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _one_to_one() -> tuple[str, str]:
    """Two strings for ``translate``: characters that Unicode maps to one other character of the same look, and those characters. By rule: what
    the character database marks as wide, narrow, font or presentation form of a single character; then the letters and signs of the look-alike tables."""
    to: dict[str, str] = {}
    for code in [*range(0xA0, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800)]:
        kind, *rest = ud.decomposition(chr(code)).split() or [""]
        if len(rest) == 1 and kind in ("<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>"):
            to[chr(code)] = chr(int(rest[0], 16))
    to |= {"\u2024": ".", "\u00b5": "\u03bc", "\u2135": "א", "\u2136": "ב", "\u2137": "ג", "\u2138": "ד"}
    letters = {x: y for m in (L.CYRILLIC_AS_LATIN, L.GREEK_AS_LATIN, L.ARMENIAN_AS_LATIN, L.ARABIC_AS_LATIN, L.HEBREW_AS_LATIN) for x, y in m.items()}
    to = {x: letters.get(y, y) for x, y in to.items()} | letters | {x: y for x, y in L.SIGNS.items() if len(y) == 1}
    return "".join(to), "".join(to.values())


_FROM, _TO = _one_to_one()
_BLANK = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_UNSEEN = r"[\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{FE00}-\x{FE0F}]"


def _look(t: str) -> str:
    """A text by its look, all look-alikes as Latin letters: which script a word is written in then does not matter for equality."""
    s = f"regexp_replace(nfc_normalize({t}), '{_UNSEEN}', '', 'g')"
    for x, y in (("\u2026", "..."), ("\u2025", ".."), ("װ", "וו"), ("ױ", "וי"), ("ײ", "יי"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﭏ", "אל")):
        s = f"replace({s}, '{x}', '{y}')"
    return f"nfc_normalize(translate({s}, {_quoted(_FROM)}, {_quoted(_TO)}))"


_IN_LINE = r"[ \t\r\f\v\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_LOOKS = rf"""
WITH r AS (SELECT DISTINCT 'curated_cases.transcript' AS field, id, transcript AS t FROM curated_cases UNION SELECT 'transcriber.hebrew_text', transcript_id, hebrew_text FROM transcriber),
x AS (SELECT field, id, t, {_look("t")} AS s FROM r WHERE id IS NOT NULL AND t IS NOT NULL),
k AS (SELECT field, id, t, trim(regexp_replace(regexp_replace(s, '{_IN_LINE}+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), ' ' || chr(10)) AS look FROM x)"""
P3_FOUND = _LOOKS + " SELECT DISTINCT a.field, a.id AS id_a, b.id AS id_b FROM k a JOIN k b ON a.field = b.field AND a.look = b.look AND a.id < b.id AND a.t <> b.t WHERE a.look <> ''"

_WORDS = f"""
w AS (SELECT field, id, regexp_replace({_look("p")}, '^\\p{{P}}+|\\p{{P}}+$', '', 'g') AS w FROM (SELECT field, id, unnest(regexp_split_to_array(t, '{_BLANK}+')) AS p FROM r WHERE id IS NOT NULL AND t IS NOT NULL)),
c AS (SELECT field, id, w, count(*) AS n FROM w WHERE w <> '' GROUP BY ALL), z AS (SELECT field, id, sum(n) AS size FROM c GROUP BY ALL)"""
_SIMILAR = """o AS (SELECT a.field AS fa, a.id AS ia, b.field AS fb, b.id AS ib, sum(least(a.n, b.n)) AS common FROM c a JOIN c b ON a.w = b.w AND {on} GROUP BY ALL),
p AS (SELECT fa, ia, fb, ib, common / (x.size + y.size - common) AS similarity FROM o JOIN z x ON x.field = fa AND x.id = ia JOIN z y ON y.field = fb AND y.id = ib WHERE common / (x.size + y.size - common) >= 0.6 - 1e-12)"""
P4_FOUND = (
    "WITH r AS (SELECT DISTINCT 'curated_cases.transcript' AS field, id, transcript AS t FROM curated_cases UNION SELECT 'transcriber.interleaved_markdown', transcript_id, interleaved_markdown FROM transcriber), "
    + _WORDS + ", " + _SIMILAR.format(on="a.field = b.field AND a.id < b.id") + " SELECT DISTINCT fa AS field, ia AS id_a, ib AS id_b FROM p"
)
_SPLITS = "WITH r AS (SELECT DISTINCT 't' AS field, id, transcript AS t FROM curated_cases UNION SELECT 'h', id, transcript FROM curated_cases_heldout), " + _WORDS + ", " + _SIMILAR.format(on="a.field = 't' AND b.field = 'h'")
P2_FOUND = _SPLITS + " SELECT DISTINCT least(ia, ib) AS id_a, greatest(ia, ib) AS id_b FROM p"
P2_REPORT = _SPLITS + """, l AS (SELECT ib AS id, count(*) AS k, max(similarity) AS best FROM p GROUP BY 1)
SELECT "set", source, count(*) AS n_records, count(k) AS n_overlapping, count(*) FILTER (WHERE best > 1 - 1e-12) AS n_exact, coalesce(sum(k), 0)::BIGINT AS n_pairs FROM (SELECT DISTINCT id, "set", source FROM curated_cases_heldout) LEFT JOIN l USING (id) GROUP BY ALL"""
P8_REPORT = _SHARES + """, q AS (SELECT lang, source, quantile_disc(share, 0.5) AS m, quantile_disc(share, 0.75) AS u FROM shares GROUP BY ALL), l AS (SELECT lang, source, greatest(u + 3.0::DOUBLE * (u - m), 1.0::DOUBLE / 2000) AS lim FROM q)
SELECT s.lang, s.source, count(*) AS n_docs, sum(n_words)::BIGINT AS n_words, sum(n_repeated)::BIGINT AS n_repeated, CASE WHEN sum(n_words) > 0 THEN sum(n_repeated)::DOUBLE / sum(n_words) END AS share, any_value(lim) AS "limit", count(*) FILTER (WHERE share >= lim) AS n_beyond
FROM shares s JOIN l ON s.lang IS NOT DISTINCT FROM l.lang AND s.source IS NOT DISTINCT FROM l.source GROUP BY s.lang, s.source"""


#: Written from the definition of the cases, with plainer patterns than the operator's; which commands are mathematics is the same fixed list.
_TAGS = "a|b|i|u|s|p|em|br|hr|h[1-6]|ul|ol|li|dl|dt|dd|tr|td|th|div|del|ins|sub|sup|pre|ref|img|span|code|font|math|mark|small|strong|table|thead|tbody|center|section|article|nowiki|details|summary|blockquote"
_HTML = rf"(?i)</?(?:{_TAGS})(?:\s[^<>]*)?/?>|<!--"
_ENTITY = r"&(?:[a-zA-Z][a-zA-Z0-9]+|#[0-9]+|#[xX][0-9a-fA-F]+);"
_NO_MATRIX = r"regexp_replace({t}, '\\(begin|end)\s*\{{(d?cases|array|small[a-z]*|[pbvBV]?matrix\*?)\}}', '', 'g')"
_COMMANDS = "len(list_filter(regexp_extract_all(" + _NO_MATRIX + r", '\\([a-zA-Z]{{2,}})', 1), lambda x: NOT list_contains([" + ", ".join(f"'{m}'" for m in M.MATH) + "], x))) > 0"
_SIGNS = (r"\\[\[\]()]", r"```|(?m)^\s*~~~", r"`[^`\n]+`", r"~~[^\s~]", r"(?m)^\s{0,3}#{1,6}[ \t]+\S", r"!?\[[^\]\n]*\]\([^)\n]*[/.#:][^)\n]*\)")
_MARKS = _SIGNS + (
    r"\\\\", r"\*\*[^\s*][^\n]*\*\*", r"(?:^|\W)__[^\s_][^\n]*__", r"(?m)^\s*(?:[-+]|\*{1,4})[ \t]+\S", r"(?m)^[ \t]{0,3}>[ \t]*\S", r"(?m)^\s{0,3}(?:-{3,}|\*{3,}|_{3,})\s*$", r"(?m)^\s*\|[^\n]*\|\s*$",
    r"'{2,5}[^'\n]+'{2,5}", r"\[\[[^\]\n]+\]\]", r"\{\{[^{}\n]+\}\}", r"\{\||\|\}", r"(?m)^\s*={2,6}[^=\n]+={2,6}\s*$", r"\[(?:https?|ftp)://",
)
_any = lambda t, patterns: " OR ".join(f"regexp_matches({t}, {_quoted(p)})" for p in patterns)
P5_FOUND = rf"""
WITH t AS (SELECT DISTINCT transcript_id, interleaved_markdown, math_latex FROM transcriber WHERE transcript_id IS NOT NULL),
m AS (SELECT transcript_id, regexp_replace(regexp_replace(regexp_replace(interleaved_markdown, '(?is)\[\[deleted:.*?(\]\]|\z)', '', 'g'), '(?s)\$\$.+?\$\$|\$[^$\n]+\$', '', 'g'), '(?m)\$[^$\n]*$', '', 'g') AS s FROM t WHERE interleaved_markdown <> ''),
f AS (SELECT transcript_id, unnest(math_latex) AS e FROM t)
SELECT transcript_id, 'interleaved_markdown' AS field FROM m WHERE {_any("s", (_HTML, _ENTITY, *_MARKS))} OR {_COMMANDS.format(t="s")}
UNION SELECT transcript_id, 'math_latex' FROM f WHERE e <> '' AND ({_any("e", (_HTML, _ENTITY, *_SIGNS, r"\$", r"(?s)^\s*(?:''.*''|\*\*.*\*\*)\s*$"))} OR {_COMMANDS.format(t="e")})"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p1_rates": P1_RATES, "p2_found": P2_FOUND, "p2_report": P2_REPORT, "p3_found": P3_FOUND, "p4_found": P4_FOUND, "p5_found": P5_FOUND, "p8_shares": P8_SHARES, "p8_found": P8_FOUND, "p8_report": P8_REPORT}
