"""Problem 3: one consistent form for texts that look the same.

``fold`` maps a token to a form that depends on its look alone, so two tokens that look the same fold to
the same string; ``fold_text`` does so for a whole text. The steps for a token are

1. canonical decomposition, invisible format characters out, wide / narrow / presentation / letter-like
   compatibility forms to their plain letters (superscripts, fractions and circled forms look different
   and stay),
2. every look-alike to one prototype letter, and per letter run the set of scripts in which each letter
   of the run can be written; the sets are intersected (resolved script set). A run whose own scripts do
   not intersect is mixed-script; a run that can wholly be written in a second script is a whole-script
   confusable,
3. the run is written in the one script that all its letters share, Latin first when several do; a run
   with no common script keeps the prototypes.

Because step 3 sees only prototypes, the outcome does not depend on how the token was spelled.
"""

from __future__ import annotations

import re
import unicodedata as ud

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Letters of other scripts drawn like a Latin letter, after the Unicode security data (UTS 39). One letter of a
#: script per Latin letter, as letters of one script that differ on the page must stay apart (so no Greek sigma beside omicron).
CYRILLIC_AS_LATIN = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ӏ": "l", "г": "r",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ѵ": "v", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H",
    "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ԍ": "G",
}
GREEK_AS_LATIN = {
    "α": "a", "γ": "y", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K",
    "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
}
ARMENIAN_AS_LATIN = {"օ": "o", "ո": "n", "հ": "h", "ս": "u", "ց": "g", "զ": "q", "յ": "j", "Օ": "O", "Տ": "S", "Լ": "L", "Ս": "U"}
ARABIC_AS_LATIN = {"ه": "o", "ا": "l"}
HEBREW_AS_LATIN = {"ס": "o"}
#: Punctuation drawn like an ASCII sign, and digraphs drawn like their letters.
SIGNS = {
    "׃": ":", "ː": ":", "∶": ":", "꞉": ":", "״": '"', "׳": "'", "‐": "-", "‑": "-", "−": "-", "˗": "-", "⁃": "-",
    "˂": "<", "‹": "<", "˃": ">", "›": ">", "ǀ": "|", "∣": "|", "׀": "|", "⁄": "/", "∕": "/", "∗": "*",
    "‚": ",", "ˆ": "^", "‗": "_", "᐀": "=", "⹀": "=", "װ": "וו", "ױ": "וי", "ײ": "יי",
}
#: Kinds of compatibility mapping whose two sides look the same.
SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
#: Where characters of the general <compat> mark look like what they map to: letter-like Hebrew, leaders of dots, ligatures and
#: presentation forms, Roman numerals, digraphs, the micro sign, doubled signs.
COMPAT = [range(a, b + 1) for a, b in ((0x2135, 0x2138), (0x2024, 0x2026), (0xFB00, 0xFB4F), (0x2160, 0x217F), (0x132, 0x133), (0x1C4, 0x1CC), (0x1F1, 0x1F3), (0xB5, 0xB5), (0x203C, 0x203C), (0x2047, 0x2049), (0x2A74, 0x2A76))]
INVISIBLE = re.compile("[͏ᅟᅠ឴឵᠋-᠎︀-️]")
#: Something that shows: neither white space nor a character without a look.
SHOWN = r"[^\s\p{Z}\p{Cc}\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{FE00}-\x{FE0F}]"
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "HEBREW", "ARABIC", "ARMENIAN")
#: Tokens that are their own form: ASCII and Hebrew letters, unless a samekh stands apart from other Hebrew letters.
PLAIN = re.compile(r"(?!.*(?<![א-ת])ס+(?![א-ת]))[!-~א-ת]*\Z")
#: Texts without any token to look at.
PLAIN_TEXT = re.compile(r"[\t-~א-נע-ת]*\Z")
_AS_LATIN = {"CYRILLIC": CYRILLIC_AS_LATIN, "GREEK": GREEK_AS_LATIN, "HEBREW": HEBREW_AS_LATIN, "ARABIC": ARABIC_AS_LATIN, "ARMENIAN": ARMENIAN_AS_LATIN}
_TO_LATIN = {k: v for m in _AS_LATIN.values() for k, v in m.items()}
_FROM_LATIN = {s: {v: k for k, v in m.items()} for s, m in _AS_LATIN.items()}


def _char(c: str) -> str:
    if ud.category(c) == "Cf" or INVISIBLE.match(c):
        return ""
    if c in SIGNS:
        return SIGNS[c]
    how = ud.decomposition(c)
    if how.startswith(SAME_LOOK) or how and any(ord(c) in r for r in COMPAT):
        return "".join(_char(chr(int(x, 16))) for x in how.split() if x[0] != "<")
    return c


def script(c: str) -> str:
    name = ud.name(c, "")
    return next((s for s in SCRIPTS if name.startswith(s)), "OTHER")


def spellings(c: str) -> set[str]:
    """Scripts in which a prototype letter can be written."""
    return {script(c)} | {s for s, to in _FROM_LATIN.items() if c in to}


def resolve(run: str) -> tuple[str, bool, bool]:
    """A letter run of any spelling: the consistent spelling, whether it was mixed-script, whether whole-script confusable."""
    letters = [c for c in run if ud.category(c)[0] == "L"]
    own = {script(c) for c in letters}
    proto = "".join(_TO_LATIN.get(c, c) for c in run)
    common: set[str] | None = None
    for c in proto:
        if ud.category(c)[0] == "L":
            common = spellings(c) if common is None else common & spellings(c)
    common = common or set()
    target = next((s for s in SCRIPTS if s in common), None)
    out = "".join(_FROM_LATIN.get(target, {}).get(c, c) for c in proto)
    return out, len(own) > 1, len(own) == 1 and len(common) > 1


def look(token: str) -> tuple[str, bool, bool]:
    """The token's form by look, whether a letter run of it is mixed-script, whether one is a whole-script confusable of another script than Latin."""
    if PLAIN.match(token):
        return token, False, False
    s = ud.normalize("NFD", "".join(map(_char, ud.normalize("NFD", token))))
    mixed = whole = False
    if not s.isascii():
        out = []
        for x in _pieces(s):
            if x[0].isalpha():
                form, m, w = resolve(x)
                mixed, whole = mixed or m, whole or w and form != x
                out.append(form)
            else:
                out.append(x)
        s = "".join(out)
    return ud.normalize("NFC", s), mixed, whole


def fold(token: str) -> str:
    """The token's form by look."""
    return look(token)[0]


def _pieces(s: str) -> list[str]:
    """Runs of letters with their marks, and what lies between."""
    out: list[str] = []
    inside = False
    for c in s:
        kind = ud.category(c)[0]
        if kind == "L" and inside or kind == "M" and out:
            out[-1] += c
        else:
            out.append(c)
            inside = kind == "L"
    return out


def fold_text(text: str, seen: dict[str, str]) -> str:
    """Whole text by look: line breaks stay, white space within a line is one blank, none at a line's ends."""
    lines = []
    for line in text.replace("\r\n", "\n").split("\n"):
        out = []
        for w in line.split():
            f = seen.get(w)
            if f is None:
                f = fold(w)
                if len(seen) < 500_000:
                    seen[w] = f
            if f:
                out.append(f)
        lines.append(" ".join(out))
    return "\n".join(lines)


def canonical(df: DataFrame, text: str, out: str = "canonical_text") -> DataFrame:
    """Adds ``out``, the text of column ``text`` in its consistent form (null stays null, empty stays empty),
    beside all other columns, whatever their names are. One Arrow pass, no shuffle."""
    if out in df.columns:
        raise ValueError(f"column {out} is there already")
    schema = StructType([*df.schema.fields, StructField(out, StringType())])

    def run(batches):
        seen: dict[str, str] = {}
        for b in batches:
            col = b.column(b.schema.get_field_index(text)).to_pylist()
            made = pa.array([None if t is None else fold_text(t, seen) for t in col], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*b.schema.names, out])

    return df.mapInArrow(run, schema)


FIELDS = (("curated_cases", "curated_cases.transcript", "id", "transcript"), ("transcriber", "transcriber.hebrew_text", "transcript_id", "hebrew_text"))


def all_texts(tables: dict[str, DataFrame], fields=FIELDS) -> DataFrame:
    """(field, id, text) of every record with a text that shows something."""
    parts = [
        tables[t].where(F.col(i).isNotNull() & F.col(x).rlike(SHOWN)).select(F.lit(f).alias("field"), F.col(i).alias("id"), F.col(x).alias("text"))
        for t, f, i, x in fields
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def keyed(texts: DataFrame) -> DataFrame:
    """(field, id, look, raw, n_mixed, n_confusable): 128-bit hashes of the consistent form and of the text as stored, and how many of its tokens
    are mixed-script and whole-script confusables. A text that shows nothing is left out; a record delivered twice comes once."""
    import xxhash

    def run(batches):
        seen: dict[str, str] = {}
        flags: dict[str, tuple[bool, bool]] = {}
        for b in batches:
            at, forms, raw, mixed, whole = [], [], [], [], []
            for k, x in enumerate(b.column(2).to_pylist()):
                f = fold_text(x, seen).strip()
                if not f:
                    continue
                m = w = 0
                if not PLAIN_TEXT.match(x):
                    for t in x.split():
                        if not PLAIN.match(t):
                            g = flags.get(t)
                            if g is None:
                                g = look(t)[1:]
                                if len(flags) < 500_000:
                                    flags[t] = g
                            m, w = m + g[0], w + g[1]
                at.append(k), mixed.append(m), whole.append(w)
                forms.append(xxhash.xxh3_128_digest(f.encode("utf-8", "surrogatepass")))
                raw.append(xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")))
            at = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array(forms, pa.binary()), pa.array(raw, pa.binary()), pa.array(mixed, pa.int32()), pa.array(whole, pa.int32())],
                names=["field", "id", "look", "raw", "n_mixed", "n_confusable"],
            )

    return texts.where("id is not null and text is not null").select("field", "id", "text").mapInArrow(run, "field string, id string, look binary, raw binary, n_mixed int, n_confusable int").distinct()


def look_pairs(texts: DataFrame) -> DataFrame:
    """Pairs of records of a field that look the same and are stored differently.

    The different spellings of a look are paired first, then each pair of spellings gets its records; so copies of one spelling never meet
    each other, and a look with one spelling takes no part at all."""
    from .common import cut

    k = cut(keyed(texts))
    one = ["field", "look"]
    spelling = k.select(*one, "raw").distinct()
    many = spelling.groupBy(*one).agg(F.count("*").alias("n")).where("n > 1").select(*one)
    spelling = cut(spelling.join(many, one, "left_semi"))
    pairs = spelling.select(*one, F.col("raw").alias("raw_a")).join(spelling.select(*one, F.col("raw").alias("raw_b")), one).where("raw_a < raw_b")
    x = pairs.join(k.select(*one, F.col("raw").alias("raw_a"), F.col("id").alias("a")), [*one, "raw_a"]).join(k.select(*one, F.col("raw").alias("raw_b"), F.col("id").alias("b")), [*one, "raw_b"])
    return x.where("a <> b").select("field", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()


def look_classes(texts: DataFrame) -> DataFrame:
    """One row per record and text: its look class, the number of spellings and records in it, and its mixed-script and confusable tokens."""
    from .common import cut

    k = cut(keyed(texts))
    per = k.groupBy("field", "look", "raw").agg(F.count("*").alias("n")).groupBy("field", "look").agg(F.count("*").alias("n_spellings"), F.sum("n").alias("n_records"))
    return k.join(per, ["field", "look"]).select("field", "id", F.lower(F.hex("look")).alias("class_id"), "n_spellings", "n_records", "n_mixed", "n_confusable")
