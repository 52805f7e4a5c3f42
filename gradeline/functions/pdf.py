"""What a digital or scanned PDF holds, read with the standard library: text spans with place and colour, and the images that fill its pages.

Read are plain and object-stream objects, Flate streams, text operators with ``ToUnicode`` maps, and images as JPEG or as 8-bit grey or RGB samples. Not
read: encrypted files, other filters, and drawings (nothing is rendered). What cannot be read is an error of its page or file, never an exception.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_TOKEN = re.compile(
    rb"\s*(?:%[^\r\n]*[\r\n]+\s*)*(?:(?P<dict><<|>>)|<(?P<hex>[0-9A-Fa-f\s]*)>|\((?P<text>(?:\\.|[^\\()]|\((?:\\.|[^\\()]|\([^()]*\))*\))*)\)|/(?P<name>[^\s/<>\[\]()%{}]*)|(?P<ref>\d+\s+\d+\s+R\b)|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+))|(?P<mark>[\[\]])|(?P<word>[A-Za-z'\"*]+\d?)|(?P<other>.))", re.S,
)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Ref(int):
    """A reference to an object by its number."""


class Name(str):
    """A name, told apart from a text."""


class Word(str):
    """An operator or keyword."""


def _string(raw: bytes) -> bytes:
    one = lambda m: _ESCAPES.get(m.group(1)) or (bytes([int(m.group(1), 8) & 255]) if m.group(1)[:1].isdigit() else b"" if m.group(1) in (b"\n", b"\r\n", b"\r") else m.group(1))
    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, raw, flags=re.S)


def values(data: bytes):
    """Values and operators of a piece of PDF, nested lists and dictionaries as such."""
    stack: list[list] = [[]]
    for m in _TOKEN.finditer(data):
        kind, raw = m.lastgroup, m.group(m.lastgroup) if m.lastgroup else b""
        if kind == "dict" and raw == b"<<" or kind == "mark" and raw == b"[":
            stack.append([])
        elif kind in ("dict", "mark"):
            got = stack.pop() if len(stack) > 1 else []
            stack[-1].append(dict(zip(map(str, got[::2]), got[1::2])) if kind == "dict" else got)
        elif kind == "hex":
            digits = re.sub(rb"\s", b"", raw)
            stack[-1].append(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))
        elif kind == "text":
            stack[-1].append(_string(raw))
        elif kind == "name":
            stack[-1].append(Name(re.sub(r"#([0-9A-Fa-f]{2})", lambda x: chr(int(x.group(1), 16)), raw.decode("latin-1"))))
        elif kind == "ref":
            stack[-1].append(Ref(raw.split()[0]))
        elif kind == "number":
            stack[-1].append(float(raw) if b"." in raw else int(raw))
        elif kind == "word":
            stack[-1].append(Word(raw.decode()))
        if len(stack) == 1:
            yield from stack[0]
            stack[0].clear()


class Document:
    def __init__(self, data: bytes):
        if not data.startswith(b"%PDF"):
            raise ValueError("not a PDF")
        if b"/Encrypt" in data:
            raise ValueError("encrypted")
        self.raw = {int(m.group(1)): m.group(2) for m in _OBJECT.finditer(data)}
        for n in list(self.raw):
            d = self.get(Ref(n))
            if isinstance(d, dict) and d.get("Type") == "ObjStm":
                body, first = self.stream(Ref(n)), int(self.get(d["First"]))
                at = list(values(body[:first]))
                ends = [*at[3::2], len(body) - first]
                self.raw |= {num: body[first + a : first + e] for num, a, e in zip(at[::2], at[1::2], ends) if num not in self.raw}

    def get(self, x):
        """The value itself, or that of the object it refers to."""
        seen = 0
        while isinstance(x, Ref) and seen < 32:
            x = next(values(self.raw.get(int(x), b"").split(b"stream", 1)[0]), None)
            seen += 1
        return x

    def filters(self, d: dict) -> list[str]:
        f = self.get(d.get("Filter"))
        return [str(f)] if isinstance(f, str) else [str(self.get(x)) for x in f or []]

    def stream(self, ref) -> bytes:
        m = _STREAM.search(self.raw.get(int(ref), b""))
        data = m.group(1) if m else b""
        for f in self.filters(self.get(ref) or {}):
            if f in ("FlateDecode", "Fl"):
                data = zlib.decompressobj().decompress(data)
            elif f not in ("DCTDecode", "DCT"):
                raise ValueError(f"filter {f}")
        return data

    def pages(self) -> list[dict]:
        """Pages in order, with what they inherit."""
        out: list[dict] = []
        root = next((d for n in self.raw if isinstance(d := self.get(Ref(n)), dict) and d.get("Type") == "Catalog"), {})
        todo = [(self.get(root.get("Pages")), {}, 0)]
        while todo:
            node, more, depth = todo.pop()
            if not isinstance(node, dict) or depth > 64:
                continue
            own = more | {k: v for k, v in node.items() if k in ("Resources", "MediaBox", "Rotate")}
            if "Kids" in node:
                todo += [(self.get(k), own, depth + 1) for k in reversed(self.get(node["Kids"]) or [])]
            else:
                out.append(own | node)
        return out

    def content(self, page: dict) -> bytes:
        c = page.get("Contents")
        refs = c if isinstance(c, list) else self.get(c) if isinstance(self.get(c), list) else [c] if c is not None else []
        return b"\n".join(self.stream(r) for r in refs if isinstance(r, Ref))

    def unicode_map(self, font: dict) -> tuple[int, dict[int, str]] | None:
        """Bytes of a code and codes to text, by a font's ``ToUnicode``."""
        if not isinstance(font, dict) or not isinstance(font.get("ToUnicode"), Ref):
            return None
        out: dict[int, str] = {}
        size, block = 1, []
        text = lambda b: b.decode("utf-16-be", "replace")
        for v in values(self.stream(font["ToUnicode"])):
            if not isinstance(v, Word):
                block.append(v)
                continue
            if v == "endcodespacerange" and block:
                size = len(block[-1])
            elif v == "endbfchar":
                out |= {int.from_bytes(a): text(b) for a, b in zip(block[::2], block[1::2])}
            elif v == "endbfrange":
                for a, b, to in zip(block[::3], block[1::3], block[2::3]):
                    for k in range(int.from_bytes(b) - int.from_bytes(a) + 1):
                        out[int.from_bytes(a) + k] = text(to[k]) if isinstance(to, list) else text(to[:-2] + (int.from_bytes(to[-2:]) + k).to_bytes(2))
            block = []
        return size, out


def _times(a: list[float], b: list[float]) -> list[float]:
    return [a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5]]


def _colour(args: list) -> int:
    v = [min(max(float(x), 0.0), 1.0) for x in args if isinstance(x, (int, float))]
    if len(v) == 4:
        v = [(1 - c) * (1 - v[3]) for c in v[:3]]
    r, g, b = (v * 3)[:3] if len(v) == 1 else v[:3] if len(v) == 3 else (0, 0, 0)
    return round(r * 255) << 16 | round(g * 255) << 8 | round(b * 255)


def page_spans(doc: Document, page: dict) -> list[tuple[str, float, float, float, int]]:
    """(text, x, y, size, colour): each shown text where it begins, y from the top of the page."""
    box = doc.get(page.get("MediaBox")) or [0, 0, 612, 792]
    top = float(doc.get(box[3]))
    fonts = doc.get((doc.get(page.get("Resources")) or {}).get("Font")) or {}
    maps: dict[str, tuple | None] = {}
    one = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]
    ctm, tm, line, colour, size, font, leading = one, one, one, 0, 0.0, "", 0.0
    saved, args, out = [], [], []

    def decode(b: bytes) -> str:
        if font not in maps:
            maps[font] = doc.unicode_map(doc.get(fonts.get(font)))
        if maps[font] is None:
            return b.decode("latin-1")
        n, to = maps[font]
        return "".join(to.get(int.from_bytes(b[i : i + n]), "") for i in range(0, len(b), n))

    def show(text: str) -> None:
        if text.strip():
            m = _times(tm, ctm)
            out.append((text.strip(), round(m[4], 2), round(top - m[5], 2), round(size * abs(m[3]), 2), colour))

    for v in values(doc.content(page)):
        if not isinstance(v, Word):
            args.append(v)
            continue
        if v == "q":
            saved.append((ctm, colour))
        elif v == "Q" and saved:
            ctm, colour = saved.pop()
        elif v == "cm" and len(args) >= 6:
            ctm = _times(args[-6:], ctm)
        elif v == "BT":
            tm = line = one
        elif v == "Tf" and len(args) >= 2:
            font, size = str(args[-2]), float(args[-1])
        elif v == "TL" and args:
            leading = float(args[-1])
        elif v in ("Td", "TD") and len(args) >= 2:
            leading = -float(args[-1]) if v == "TD" else leading
            tm = line = _times([1, 0, 0, 1, float(args[-2]), float(args[-1])], line)
        elif v == "Tm" and len(args) >= 6:
            tm = line = [float(a) for a in args[-6:]]
        elif v in ("T*", "'", '"'):
            tm = line = _times([1, 0, 0, 1, 0, -leading], line)
        elif v in ("g", "rg", "k", "sc", "scn"):
            colour = _colour(args)
        if v in ("Tj", "'", '"') and args and isinstance(args[-1], bytes):
            show(decode(args[-1]))
        elif v == "TJ" and args and isinstance(args[-1], list):
            show("".join(decode(a) if isinstance(a, bytes) else " " if isinstance(a, (int, float)) and a < -200 else "" for a in args[-1]))
        args = []
    return out


def page_images(doc: Document, page: dict) -> list[dict]:
    """Images of a page, the largest first: width, height, channels, format (``jpeg`` or ``raw``) and bytes."""
    objects = doc.get((doc.get(page.get("Resources")) or {}).get("XObject")) or {}
    out = []
    for ref in objects.values():
        d = doc.get(ref)
        if not isinstance(d, dict) or d.get("Subtype") != "Image":
            continue
        w, h = int(doc.get(d["Width"])), int(doc.get(d["Height"]))
        data, is_jpeg = doc.stream(ref), bool({"DCTDecode", "DCT"} & set(doc.filters(d)))
        space = doc.get(d.get("ColorSpace"))
        channels = {"DeviceGray": 1, "DeviceRGB": 3}.get(str(space), 3 if is_jpeg else 0)
        if not is_jpeg and (doc.get(d.get("BitsPerComponent")) != 8 or len(data) != w * h * channels):
            raise ValueError(f"image of {space} with {doc.get(d.get('BitsPerComponent'))} bits")
        out.append({"width": w, "height": h, "channels": channels, "format": "jpeg" if is_jpeg else "raw", "data": data})
    return sorted(out, key=lambda i: -i["width"] * i["height"])


def read(data: bytes, what) -> list[tuple[int | None, list, str | None]]:
    """(page index, ``what`` of it, error) of every page; one row without a page where the file cannot be opened."""
    try:
        doc = Document(data)
        pages = doc.pages()
    except Exception as e:  # noqa: BLE001 - a damaged file is a row with an error
        return [(None, [], f"cannot be opened: {e}")]
    out = []
    for i, page in enumerate(pages):
        try:
            out.append((i, what(doc, page), None))
        except Exception as e:  # noqa: BLE001 - so is a damaged page
            out.append((i, [], f"page {i}: {e}"))
    return out or [(None, [], "no pages")]
