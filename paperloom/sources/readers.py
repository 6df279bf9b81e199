"""Readers of page lists that need no library beyond Python's own."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

from . import files, pdf

#: Bytes that a Word document's text part may inflate to.
INFLATED = 1 << 27
#: Fixed value: the namespace of Word's elements.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _paragraph(p: ElementTree.Element) -> str:
    parts = {f"{_W}t": lambda e: e.text or "", f"{_W}tab": lambda e: "\t", f"{_W}br": lambda e: "\n"}
    return "".join(parts[e.tag](e) for e in p.iter() if e.tag in parts)


def docx_pages(raw: bytes) -> list[tuple[str, bool]]:
    """One page: the body's paragraphs that are not blank, then the rows of its tables, cells tab-joined."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        if z.getinfo("word/document.xml").file_size > INFLATED:
            raise ValueError("a document that inflates past the bound")
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    lines = [t for p in body.findall(f"{_W}p") if (t := _paragraph(p)).strip()]
    for row in (r for t in body.findall(f"{_W}tbl") for r in t.findall(f"{_W}tr")):
        cells = ["\n".join(map(_paragraph, c.findall(f"{_W}p"))).strip() for c in row.findall(f"{_W}tc")]
        if any(cells):
            lines.append("\t".join(cells))
    return [("\n".join(lines), False)] if lines else []


def plain_pages(raw: bytes) -> list[tuple[str, bool]]:
    for charset in files.CHARSETS:
        try:
            text = raw.decode(charset)
        except UnicodeDecodeError:
            continue
        return [(text, False)] if text.strip() else []
    return []


def register() -> None:
    """Plain text, Word and PDF. Images and OCR need a library; their readers come by register_reader."""
    files.register_reader("text/plain", plain_pages)
    files.register_reader(files.DOCX, docx_pages)
    files.register_reader("application/pdf", pdf.pages)


register()
