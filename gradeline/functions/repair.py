"""JSON of models, read with tolerance: TeX backslashes, bare quotes inside strings, missing ends, fences and words around."""

from __future__ import annotations

import json
import re

_FENCE = re.compile(r"\A```(?:json)?|```\Z")
_SPACE = re.compile(r"[ \t\r\n]*")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?")
_WORDS = {"true": True, "false": False, "null": None, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}
#: Escapes that mean in JSON what they say; n, r and t only where no letter follows, as with one they begin a TeX command.
_KNOWN = re.compile(r"""\\(?:u([0-9a-fA-F]{4})|(["\\/])|([nrt])(?![^\W\d_]))""")
_CONTROL = {"n": "\n", "r": "\r", "t": "\t"}
_PLAIN = re.compile(r'[^"\\\x00-\x1f]+')


class Unreadable(ValueError):
    pass


class _Reader:
    """One pass over a text. A backslash that JSON does not know stands for itself. A quote ends a string only where
    one of , } ] : or the end follows. Where an object breaks off, what is open counts as closed, if it broke off behind a value or inside a string value."""

    def __init__(self, text: str):
        self.text, self.at = text, 0
        self.may_break = text.startswith("{")

    def next(self) -> str:
        self.at = _SPACE.match(self.text, self.at).end()
        return self.text[self.at : self.at + 1]

    def document(self):
        v = self.value()
        if self.next():
            raise Unreadable(self.at)
        return v

    def value(self):
        c = self.next()
        if c == "{":
            return dict(self.items("}", self.member))
        if c == "[":
            return list(self.items("]", self.value))
        if c == '"':
            return self.string()
        word = next((w for w in _WORDS if self.text.startswith(w, self.at)), None)
        if word:
            self.at += len(word)
            return _WORDS[word]
        m = _NUMBER.match(self.text, self.at)
        if not m:
            raise Unreadable(self.at)
        self.at = m.end()
        return float(m.group(0)) if m.group(1) or m.group(2) else int(m.group(0))

    def items(self, end: str, item):
        self.at += 1
        c = self.next()
        while c and c != end:
            yield item()
            c = self.next()
            if c == ",":
                self.at += 1
                if self.next() in ("", end):
                    raise Unreadable(self.at)
            elif c and c != end:
                raise Unreadable(self.at)
        if not c and not self.may_break:
            raise Unreadable(self.at)
        self.at += len(c)

    def member(self):
        if self.next() != '"':
            raise Unreadable(self.at)
        name = self.string()
        if self.next() != ":":
            raise Unreadable(self.at)
        self.at += 1
        return name, self.value()

    def string(self) -> str:
        out = []
        self.at += 1
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == '"':
                after = _SPACE.match(self.text, self.at + 1).end()
                self.at += 1
                if self.text[after : after + 1] in ("", ",", "}", "]", ":"):
                    return "".join(out)
                out.append(c)
            elif c == "\\":
                m = _KNOWN.match(self.text, self.at)
                out.append(c if not m else m.group(2) or _CONTROL.get(m.group(3)) or chr(int(m.group(1), 16)))
                self.at = m.end() if m else self.at + 1
            elif m := _PLAIN.match(self.text, self.at):
                out.append(m.group(0))
                self.at = m.end()
            else:
                raise Unreadable(self.at)
        if not self.may_break:
            raise Unreadable(self.at)
        return "".join(out)


def tolerant(text: str):
    """Value of a text in JSON with faults; raises a ValueError if it cannot be read."""
    try:
        return _Reader(text).document()
    except RecursionError as e:
        raise Unreadable(text[:40]) from e


def loads(text: str | None):
    """Strictly where that goes, else with tolerance; the whole text, else what stands from its first to its last brace. None if nothing can be read."""
    base = _FENCE.sub("", (text or "").strip()).strip()
    inner = base[base.find("{") : base.rfind("}") + 1] if "{" in base else ""
    for t in dict.fromkeys(x for x in (base, inner) if x):
        for read in (json.loads, tolerant):
            try:
                return read(t)
            except (ValueError, RecursionError):
                pass
    return None


def canonical(x) -> str:
    """JSON with sorted keys, as input of hashes."""
    return json.dumps(x, sort_keys=True, ensure_ascii=False)
