"""PDF files made here: text with maps and colours, scanned pages, object streams, damage."""

import zlib

from gradeline.functions import pdf
from gradeline.sources import files


def made(*objects: tuple[int, bytes]) -> bytes:
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % o for o in objects) + b"trailer << /Root 1 0 R >>\n%%EOF"


def stream(body: bytes, more: bytes = b"", packed: bool = True) -> bytes:
    body = zlib.compress(body) if packed else body
    return b"<< /Length %d %s %s >>\nstream\n%s\nendstream" % (len(body), b"/Filter /FlateDecode" if packed else b"", more, body)


TEXT = rb"q 1 0 0 1 10 0 cm BT /F1 12 Tf 0.9 0.1 0 rg 100 700 Td (a \(b\) \101) Tj 0 g 0 -20 TD [(x) -300 (y)] TJ T* <4142> Tj ET Q BT /F2 10 Tf 1 0 0 1 50 600 Tm <0001000200FF> Tj ET"
MAP = b"/CIDInit begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <05D0> endbfchar 1 beginbfrange <0002> <0003> <05D1> endbfrange endcmap"
PAGE = b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 << /Type /Font >> /F2 << /ToUnicode 5 0 R >> >> >> >>"
TREE = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 600 800] >>")]


def test_spans():
    doc = pdf.Document(made(*TREE, (3, PAGE), (4, stream(TEXT)), (5, stream(MAP))))
    assert pdf.page_spans(doc, doc.pages()[0]) == [("a (b) A", 110.0, 100.0, 12.0, 0xE61A00), ("x y", 110.0, 120.0, 12.0, 0), ("AB", 110.0, 140.0, 12.0, 0), ("אב", 50.0, 200.0, 10.0, 0)]


def test_object_streams():
    inner = [TREE[1][1], PAGE]
    at = b"2 0 3 %d " % (len(inner[0]) + 1)
    packed = stream(at + b"\n".join(inner), b"/Type /ObjStm /N 2 /First %d" % len(at))
    doc = pdf.Document(made(TREE[0], (4, stream(TEXT)), (5, stream(MAP)), (9, packed)))
    assert len(doc.pages()) == 1 and pdf.page_spans(doc, doc.pages()[0])[0][0] == "a (b) A"


def test_files(spark, tmp_path):
    page = b"<< /Type /Page /Resources << /XObject << /I 6 0 R /J 7 0 R >> >> >>"
    image = lambda w, h, space: b"/Subtype /Image /Width %d /Height %d /BitsPerComponent 8 /ColorSpace /%s" % (w, h, space)
    (tmp_path / "scan.pdf").write_bytes(made(*TREE, (3, page), (6, stream(bytes(6), image(3, 2, b"DeviceGray"))), (7, stream(bytes(36), image(4, 3, b"DeviceRGB")))))
    (tmp_path / "text.PDF").write_bytes(made(*TREE, (3, PAGE), (4, stream(TEXT)), (5, stream(MAP))))
    (tmp_path / "bad.pdf").write_bytes(b"no pdf")
    (tmp_path / "odd.pdf").write_bytes(made(*TREE, (3, page), (6, stream(b"x", image(3, 2, b"DeviceGray"))), (7, stream(bytes(36), image(4, 3, b"DeviceRGB")))))
    name = lambda r: r.path.rsplit("/", 1)[-1]
    got = sorted((name(r), r.page_index, r.pos, r.width, r.height, r.channels, r.format, len(r.data)) for r in files.pdf_images(spark, str(tmp_path)).where("data is not null").collect())
    assert got == [("scan.pdf", 0, 0, 4, 3, 3, "raw", 36), ("scan.pdf", 0, 1, 3, 2, 1, "raw", 6)]
    errors = {name(r): r.error for r in files.pdf_images(spark, str(tmp_path)).where("error is not null").collect()}
    assert errors == {"bad.pdf": "cannot be opened: not a PDF", "odd.pdf": "page 0: image of DeviceGray with 8 bits"}
    spans = files.pdf_spans(spark, str(tmp_path)).where("text is not null").collect()
    assert {name(r) for r in spans} == {"text.PDF"} and [r.text for r in sorted(spans, key=lambda r: r.pos)] == ["a (b) A", "x y", "AB", "אב"]
