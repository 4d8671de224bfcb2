from __future__ import annotations

import io
import zipfile
import zlib

import pytest

from codexframe.sources import extract
from codexframe.sources.files import extract_files, intake, read_files

MARK = "marker text of the test, long enough"


def zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def docx(*paragraphs: tuple[str, str]) -> bytes:
    body = "".join(f"<w:p><w:pPr><w:pStyle w:val='{style}'/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>" for style, t in paragraphs)
    return zipped({"word/document.xml": f"<w:document xmlns:w='urn:w'><w:body>{body}</w:body></w:document>"})


def slide(text: str) -> str:
    return f"<p:sld xmlns:p='urn:p' xmlns:a='urn:a'><a:t>{text}</a:t></p:sld>"


def epub(*chapters: str) -> bytes:
    items = "".join(f"<item id='c{i}' href='t/c{i}.xhtml'/>" for i in range(len(chapters)))
    refs = "".join(f"<itemref idref='c{i}'/>" for i in range(len(chapters)))
    parts = {
        "META-INF/container.xml": "<container><rootfiles><rootfile full-path='OPS/p.opf'/></rootfiles></container>",
        "OPS/p.opf": f"<package><manifest>{items}</manifest><spine>{refs}</spine></package>",
    }
    return zipped(parts | {f"OPS/t/c{i}.xhtml": c for i, c in enumerate(chapters)})


def pdf(*pages: str, flate: bool = False) -> bytes:
    out = b"%PDF-1.4\n1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj\n"
    kids = " ".join(f"{3 + 2 * i} 0 R" for i in range(len(pages)))
    out += f"2 0 obj <</Type /Pages /Kids [{kids}] /Count {len(pages)}>> endobj\n".encode()
    for i, text in enumerate(pages):
        content = f"BT /F1 12 Tf ({text}) Tj ET".encode("latin-1")
        content = zlib.compress(content) if flate else content
        out += f"{3 + 2 * i} 0 obj <</Type /Page /Parent 2 0 R /Contents {4 + 2 * i} 0 R>> endobj\n".encode()
        out += f"{4 + 2 * i} 0 obj <</Length {len(content)}{' /Filter /FlateDecode' if flate else ''}>>\nstream\n".encode() + content + b"\nendstream endobj\n"
    return out + b"%%EOF"


def test_docx():
    assert extract.extract(docx(("Normal", MARK)), "docx") == [(MARK, None, "Nội dung tài liệu")]
    got = extract.extract(docx(("Normal", "intro"), ("Heading1", "One"), ("Normal", "first"), ("Heading2", "Two"), ("Normal", "second")), "docx")
    assert got == [("intro", None, "Nội dung tài liệu"), ("One\nfirst", None, "One"), ("Two\nsecond", None, "Two")]
    assert extract.extract(docx(), "docx") == [("", None, "Nội dung tài liệu")]


def test_pptx_orders_slides_by_number():
    data = zipped({"ppt/slides/slide10.xml": slide("tenth"), "ppt/slides/slide2.xml": slide(""), "ppt/slides/slide1.xml": slide(MARK)})
    assert extract.extract(data, "pptx") == [(MARK, 1, "Slide 1"), ("tenth", 3, "Slide 3")]


def test_epub():
    page = f"<html><head><title>T</title></head><body><nav>menu</nav><h1>Start</h1><p>{MARK}</p><script>x</script></body></html>"
    got = extract.extract(epub("<html><body></body></html>", page, f"<html><body><p>{MARK}</p></body></html>"), "epub")
    assert [s[2] for s in got] == ["Chương 2: T", "Chương 3"] and MARK in got[0][0] and "menu" not in got[0][0] and "x" not in got[0][0].split()
    with pytest.raises(extract.ExtractionError):
        extract.extract(zipped({"a": "b"}), "epub")


@pytest.mark.parametrize("flate", [False, True])
def test_pdf(flate):
    got = extract.extract(pdf(MARK, "", r"esc \(x\) \101", flate=flate), "pdf")
    assert got == [(MARK, 1, "Trang 1"), ("esc (x) A", 3, "Trang 3")]
    with pytest.raises(extract.ExtractionError):
        extract.extract(b"no", "pdf")


@pytest.fixture
def inbox(tmp_path):
    box = tmp_path / "in"
    box.mkdir()
    (box / "a b.docx").write_bytes(docx(("Normal", MARK + " " + " ".join(["w"] * 900))))
    (box / "c.PDF").write_bytes(pdf(MARK))
    (box / "bad.docx").write_bytes(b"broken")
    (box / "short.pdf").write_bytes(pdf("tiny"))
    (box / "note.txt").write_bytes(b"text")
    (box / "empty.pdf").write_bytes(b"")
    return box


def test_intake_and_extraction(spark, inbox):
    rows = {r.title: r for r in intake(read_files(spark, str(inbox))).drop("content").collect()}
    assert rows["a b"].reject is None and rows["c"].file_type == "pdf" and rows["note"].reject == "unsupported type"
    listed = spark.createDataFrame([("/x/.pdf", 0), ("/x/a.pdf", 26 * 2**20), ("/x/a.b.PPTX", 5)], "path string, length long")
    judged = [(r.title, r.reject) for r in intake(listed).collect()]
    assert judged == [(".pdf", "empty file"), ("a", "too large"), ("a.b", None)]
    good = intake(read_files(spark, str(inbox))).where("reject is null")
    done = {r.id.rsplit("/", 1)[1]: r for r in extract_files(good).collect()}
    assert done["c.PDF"].error is None and done["bad.docx"].error.startswith("damaged") and done["short.pdf"].error == "too little text"


def test_streaming_ingest_runs_once_per_file(spark, inbox, tmp_path):
    from codexframe.operators.embedding import hashing_embedder
    from codexframe.streaming.ingest import ingest

    for _ in range(2):  # the second run finds nothing new
        query = ingest(spark, str(inbox), str(tmp_path / "out"), str(tmp_path / "check"), hashing_embedder(16), 16)
        query.awaitTermination()
    documents = spark.read.parquet(str(tmp_path / "out/documents")).collect()
    assert {r.title: r.status for r in documents} == {"a b": "READY", "c": "READY", "bad": "FAILED", "short": "FAILED"}
    chunks = spark.read.parquet(str(tmp_path / "out/chunks")).collect()
    assert len(chunks) == 4 and all(len(r.embedding) == 16 for r in chunks)
    jobs = spark.read.parquet(str(tmp_path / "out/jobs"))
    assert jobs.where("status = 'COMPLETED'").count() == 6 and jobs.where("status = 'FAILED'").count() == 8


def test_pages_follow_a_nested_tree():
    texts = [f"{MARK} {n}" for n in range(4)]
    page = lambda n, body: f"{n} 0 obj << /Type /Page /Contents {n + 10} 0 R >> endobj\n{n + 10} 0 obj << >> stream\nBT {body} ET\nendstream endobj\n"
    data = "%PDF-1.4\n8 0 obj << /Type /Pages /Kids [5 0 R 4 0 R] >> endobj\n9 0 obj << /Type /Pages /Kids [8 0 R 7 0 R] >> endobj\n"
    data += "7 0 obj << /Type /Pages /Kids [3 0 R 2 0 R] >> endobj\n1 0 obj << /Type /Catalog /Pages 9 0 R >> endobj\n"
    for n, text in zip((5, 4, 3, 2), texts):
        shown = f"({text}) Tj" if n % 2 else f"<{text.encode('utf-16-be').hex() if n < 0 else text.encode('latin-1', 'replace').hex()}> Tj"
        data += page(n, shown)
    got = extract.extract(data.encode("latin-1", "replace"), "pdf")
    assert [s[1] for s in got] == [1, 2, 3, 4] and [s[0][-1] for s in got] == ["0", "1", "2", "3"]


@pytest.mark.parametrize("change", ["encrypted", "damaged"])
def test_a_file_that_cannot_be_read_fails_alone(change):
    data = bytearray(docx(("Normal", MARK)))
    at = data.find(b"PK\x01\x02") if change == "encrypted" else 45
    while change == "encrypted" and at >= 0:
        data[at + 8] |= 1
        at = data.find(b"PK\x01\x02", at + 4)
    if change == "damaged":
        data[60:90] = b"\xff" * 30
    with pytest.raises(extract.ExtractionError):
        extract.extract(bytes(data), "docx")


def test_a_word_too_long_to_embed_fails_its_document(spark, tmp_path):
    from codexframe.operators.embedding import hashing_embedder
    from codexframe.plans.jobs import run_pipeline

    (tmp_path / "long.docx").write_bytes(docx(("Normal", MARK + " " + "x" * 20_001)))
    (tmp_path / "good.docx").write_bytes(docx(("Normal", MARK)))
    out = run_pipeline(read_files(spark, str(tmp_path)), hashing_embedder(8), 8)
    assert {r.title: (r.status, r.error is None) for r in out["documents"].collect()} == {"long": ("EXTRACTED", False), "good": ("READY", True)}
    assert all((r.embedding is None) == (len(r.content) > 20_000) for r in out["chunks"].collect())
    assert out["jobs"].where("status = 'COMPLETED'").count() == 5
