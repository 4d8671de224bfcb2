"""Located sections of PDF, DOCX, PPTX, EPUB and HTML files, with the standard library only."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from html.parser import HTMLParser
from xml.etree import ElementTree

from codexframe.functions.text import normalize_text_py

# fixed values: labels of sections
DOCX_LABEL, PDF_LABEL, SLIDE_LABEL, CHAPTER_LABEL = "Nội dung tài liệu", "Trang {n}", "Slide {n}", "Chương {n}"

Section = tuple[str, int | None, str | None]


class ExtractionError(ValueError):
    """A file whose text can't be had; the message says why."""


class _Html(HTMLParser):
    """Text of the body and the first heading, without scripts, styles and navigation."""

    SKIP, HEADINGS = {"script", "style", "nav"}, {"h1", "h2", "title"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skipped, self.in_head, self.inside = 0, False, 0
        self.body: list[str] = []
        self.headings: list[list[str]] = []

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skipped += 1
        elif tag == "head":
            self.in_head = True
        elif tag == "body":
            self.in_head = False
        if tag in self.HEADINGS and not self.skipped:
            self.inside += 1
            self.headings.append([])

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skipped = max(0, self.skipped - 1)
        elif tag == "head":
            self.in_head = False
        if tag in self.HEADINGS:
            self.inside = max(0, self.inside - 1)

    def handle_data(self, data):
        if self.skipped:
            return
        if self.inside and self.headings:
            self.headings[-1].append(data)
        if not self.in_head:
            self.body.append(data)


def html_section(html: str, n: int) -> Section | None:
    """The ``n``-th chapter's text under ``Chương n: heading``; none if it is empty."""
    parser = _Html()
    parser.feed(html)
    parser.close()
    text = normalize_text_py("".join(parser.body))
    heading = "".join(parser.headings[0]).strip() if parser.headings else ""
    name = CHAPTER_LABEL.format(n=n)
    return (text, None, f"{name}: {heading}" if heading else name) if text else None


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _part(archive: zipfile.ZipFile, name: str) -> bytes | None:
    try:
        return archive.read(name)
    except KeyError:
        return None


def docx_sections(data: bytes) -> list[Section]:
    """Headings open sections and name them; the heading is also the section's first line."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        body = _part(archive, "word/document.xml")
    if body is None:
        raise ExtractionError("no document part")
    found: list[Section] = []
    label, lines = DOCX_LABEL, []

    def text_of(node) -> str:
        out = []
        for x in node.iter():
            kind = _local(x.tag)
            out.append(x.text or "" if kind == "t" else "\t" if kind == "tab" else "\n" if kind == "br" else "")
        return "".join(out).strip()

    def close() -> None:
        text = normalize_text_py("\n".join(lines))
        if text:
            found.append((text, None, label))
        lines.clear()

    root = ElementTree.fromstring(body)
    for block in next((x for x in root if _local(x.tag) == "body"), ()):
        text = text_of(block)
        if not text:
            continue
        style = next((v for x in block.iter() if _local(x.tag) == "pStyle" for k, v in x.attrib.items() if _local(k) == "val"), "")
        if _local(block.tag) == "p" and re.fullmatch(r"(?i)heading\s?[1-6]", style):
            close()
            label = text
        lines.append(text)
    close()
    return found or [("", None, label)]


def pptx_sections(data: bytes) -> list[Section]:
    """Slides in the order of their numbers; the page is the place in that order, also past empty slides."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        numbered = [(int(m[1]), name) for name in archive.namelist() if (m := re.fullmatch(r"(?i)ppt/slides/slide(\d+)\.xml", name))]
        found: list[Section] = []
        for n, (_, name) in enumerate(sorted(numbered), 1):
            runs = [(x.text or "").strip() for x in ElementTree.fromstring(archive.read(name)).iter() if _local(x.tag) == "t"]
            text = normalize_text_py("\n".join(r for r in runs if r))
            if text:
                found.append((text, n, SLIDE_LABEL.format(n=n)))
    return found


def epub_sections(data: bytes) -> list[Section]:
    """Chapters in reading order; the number counts all of them, the empty ones too."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        container = _part(archive, "META-INF/container.xml")
        if container is None:
            raise ExtractionError("no container")
        package = next((x.get("full-path") for x in ElementTree.fromstring(container).iter() if _local(x.tag) == "rootfile"), None)
        if not package:
            raise ExtractionError("no package document named")
        opf = _part(archive, package)
        if opf is None:
            raise ExtractionError("no package document")
        tree = list(ElementTree.fromstring(opf).iter())
        files = {x.get("id"): x.get("href") for x in tree if _local(x.tag) == "item" and x.get("id") and x.get("href")}
        order = [files[x.get("idref")] for x in tree if _local(x.tag) == "itemref" and x.get("idref") in files]
        found: list[Section] = []
        for n, href in enumerate(order, 1):
            chapter = _part(archive, posixpath.normpath(posixpath.join(posixpath.dirname(package), href)))
            section = html_section(chapter.decode("utf-8", "replace"), n) if chapter else None
            if section:
                found.append(section)
    return found


def _pdf_string(raw: bytes) -> str:
    escapes = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}

    def one(m: re.Match) -> bytes:
        return bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else escapes.get(m[1], m[1])

    return re.sub(rb"\\([0-7]{1,3}|.)", one, raw, flags=re.S).decode("latin-1")


_SHOW = re.compile(rb"\(((?:\\.|[^\\()])*)\)\s*(?:Tj|'|\")|\[((?:\((?:\\.|[^\\()])*\)|[^\]])*)\]\s*TJ|(T\*|ET|Td|TD)|<([0-9A-Fa-f\s]*)>\s*(?:Tj|'|\")", re.S)
#: Bytes that one stream may inflate to.
MOST_BYTES = 64 << 20


def _pdf_hex(digits: bytes) -> str:
    """A hex string of single bytes, or of UTF-16 with its mark."""
    bare = re.sub(rb"\s", b"", digits)
    raw = bytes.fromhex((bare + b"0" * (len(bare) % 2)).decode())
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")


def _kids(body: bytes) -> list[int]:
    listed = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
    return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", listed[1])] if listed else []


def _page_order(objects: dict[int, bytes], pages: set[int]) -> list[bytes]:
    """Page objects as the page tree has them, from its roots down; pages outside of it come last."""
    below = {n: _kids(body) for n, body in objects.items()}
    inner = {x for kids in below.values() for x in kids}
    todo, order = [n for n in sorted(below, reverse=True) if below[n] and n not in inner], {}
    seen: set[int] = set()
    while todo:
        n = todo.pop()
        if n in seen:
            continue
        seen.add(n)
        if n in pages:
            order[n] = objects[n]
        todo += reversed(below.get(n, []))
    return [*order.values(), *(objects[n] for n in sorted(pages - order.keys()))]


def pdf_sections(data: bytes) -> list[Section]:
    """Pages with a text layer of simple strings (``Tj``, ``TJ``), also hex ones, plain or Flate; page numbers count all pages in the order of the page tree."""
    if not data.startswith(b"%PDF"):
        raise ExtractionError("not a PDF")
    objects = {int(m[1]): m[2] for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)endobj", data, re.S)}
    pages = [body for _, body in sorted(objects.items()) if re.search(rb"/Type\s*/Page(?![A-Za-z])", body)]
    pages = _page_order(objects, {n for n, body in objects.items() if re.search(rb"/Type\s*/Page(?![A-Za-z])", body)}) or pages
    found: list[Section] = []
    for n, page in enumerate(pages, 1):
        contents = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", page, re.S)
        lines: list[str] = [""]
        for ref in re.findall(rb"(\d+)\s+\d+\s+R", contents[1]) if contents else ():
            body = objects.get(int(ref), b"")
            stream = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
            if not stream:
                continue
            content = stream[1]
            if b"FlateDecode" in body[: stream.start()]:
                try:
                    inflate = zlib.decompressobj()
                    content = inflate.decompress(content, MOST_BYTES)
                    if inflate.unconsumed_tail:
                        raise ExtractionError(f"a stream has more than {MOST_BYTES} bytes")
                except zlib.error as error:
                    raise ExtractionError("a stream can't be inflated") from error
            for m in _SHOW.finditer(content):
                if m[3]:
                    lines.append("")
                elif m[1] is not None:
                    lines[-1] += _pdf_string(m[1])
                elif m[4] is not None:
                    lines[-1] += _pdf_hex(m[4])
                else:
                    parts = re.finditer(rb"\(((?:\\.|[^\\()])*)\)|<([0-9A-Fa-f\s]*)>", m[2], re.S)
                    lines[-1] += "".join(_pdf_string(x[1]) if x[1] is not None else _pdf_hex(x[2]) for x in parts)
        text = normalize_text_py("\n".join(x for x in lines if x))
        if text:
            found.append((text, n, PDF_LABEL.format(n=n)))
    return found


EXTRACTORS = {"pdf": pdf_sections, "docx": docx_sections, "pptx": pptx_sections, "epub": epub_sections}


def extract(data: bytes, kind: str) -> list[Section]:
    """Sections of a file of one of the four kinds."""
    if kind not in EXTRACTORS:
        raise ExtractionError(f"unsupported type {kind}")
    try:
        return EXTRACTORS[kind](data)
    except ExtractionError:
        raise
    except Exception as error:  # whatever a damaged, encrypted or hostile file sets off fails this file alone
        raise ExtractionError(f"damaged file: {error}") from error
