"""Documents from files: Word files, page-wise PDF text with OCR, one dispatcher.

Files are read as binary rows, so they spread over tasks; a file that can't be read
becomes a row with an error, never a failed job. PDF pages and OCR come from providers
that the caller plugs in (no PDF library is required here).
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.layout import rebuilt

ACCEPTED = ("pdf", "doc", "docx")
#: Files and characters of their texts that a task holds before it sends them on.
SENT_FILES, SENT_CHARS = 256, 1 << 20
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


class OcrError(Exception):
    """kind: BinaryNotFound, InvalidImage, ExecutionFailed, Timeout or EmptyOutput."""

    def __init__(self, kind: str, detail: str = ""):
        super().__init__(f"{kind}: {detail}" if detail else kind)
        self.kind = kind


class OcrProvider(Protocol):
    name: str

    def is_available(self) -> bool: ...

    def extract_text(self, image: bytes) -> str: ...


@dataclass
class MockOcr:
    """A fixed text or error, with a count of calls."""

    text: str = ""
    error: str | None = None
    name: str = "mock"
    calls: int = field(default=0)

    def is_available(self) -> bool:
        return True

    def extract_text(self, image: bytes) -> str:
        self.calls += 1
        if self.error:
            raise OcrError(self.error)
        return self.text


@dataclass
class Page:
    """What a PDF reader gives for a page: its text layer, and an image where there is one."""

    text: str | None = None
    image: bytes | None = None


def docx_text(content: bytes) -> str:
    """Text runs with a blank after each and a line for each paragraph."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            root = ElementTree.fromstring(archive.read("word/document.xml"))
    except zipfile.BadZipFile as e:
        raise ValueError(f"Failed to open DOCX: {e}") from e
    except KeyError as e:
        raise ValueError("DOCX has no document.xml") from e
    parts: list[str] = []
    for paragraph in root.iter(f"{_W}p"):
        parts += [(t.text or "") + " " for t in paragraph.iter(f"{_W}t")] + ["\n"]
    text = "".join(parts)
    if not text.strip():
        raise ValueError("DOCX has no extractable text")
    return text


def docx_file(text: str) -> bytes:
    """A Word file with a paragraph for each line."""
    out = io.BytesIO()
    lines = "".join(f"<w:p><w:r><w:t>{escape(line)}</w:t></w:r></w:p>" for line in text.split("\n"))
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{lines}</w:body></w:document>')
    return out.getvalue()


def page_usable(text: str) -> bool:
    """The row-wise twin of ``functions.text.page_quality`` for use beside the OCR provider."""
    t = text.strip()
    printable = sum(c in "\n\t" or not (ord(c) < 32 or 127 <= ord(c) < 160) for c in t)
    return bool(t) and printable / len(t) >= 0.75 and len(t.split()) >= 10 and len(t) >= 30 and sum(map(str.isalpha, t)) >= 15


def combined(pages: Sequence[str]) -> str:
    """Normalised pages joined by blank lines; empty ones and repeats of the last kept one are left out."""
    kept: list[str] = []
    for text in (rebuilt(p).strip() for p in pages):
        if text and (not kept or kept[-1] != text):
            kept.append(text)
    return "\n\n".join(kept)


def hybrid_pages(pages: Sequence[Page], ocr: OcrProvider | None) -> dict:
    """Text of a PDF's pages: a usable text layer first, else OCR, else what text there is (not counted)."""
    if not pages:
        raise ValueError("PDF has no pages")
    texts, native, scanned = [], 0, 0
    for page in pages:
        own = page.text or ""
        if page_usable(own):
            texts.append(own)
            native += 1
            continue
        read = ""
        if page.image is not None and ocr is not None and ocr.is_available():
            try:
                read = ocr.extract_text(page.image).strip()
            except OcrError:
                read = ""
        if read:
            texts.append(read)
            scanned += 1
        elif own.strip():
            texts.append(own)
    text = combined(texts)
    if not text:
        raise ValueError("PDF is scanned or has no extractable text layer")
    method = "hybrid" if native and scanned else "ocr" if scanned else "text"
    return {"text": text, "method": method, "text_pages": native, "ocr_pages": scanned, "total_pages": len(pages)}


def native_pages(pages: Sequence[Page]) -> dict:
    """Text of a PDF's text layer alone: pages joined by line ends, normalised once as a whole."""
    text = "".join((p.text or "") + "\n" for p in pages)
    if not text.strip():
        raise ValueError("PDF is scanned or has no extractable text layer")
    return {"text": rebuilt(text), "method": "text", "text_pages": len(pages), "ocr_pages": 0, "total_pages": len(pages)}


PdfReader = Callable[[bytes], Sequence[Page]]


def extracted(path: str, content: bytes, pdf: PdfReader | None, ocr: OcrProvider | None, native: bool = False) -> dict:
    """The record of one file by its extension; raises for what can't be read. ``native`` reads a PDF's text layer alone."""
    kind = (re.search(r"\.([^./\\]*)$", path) or ["", ""])[1].lower()
    if kind == "pdf":
        if pdf is None:
            raise ValueError("no PDF reader is plugged in")
        return native_pages(pdf(content)) if native else hybrid_pages(pdf(content), ocr)
    if kind in ("docx", "doc"):
        try:
            return {"text": rebuilt(docx_text(content)), "method": "text", "text_pages": None, "ocr_pages": None, "total_pages": None}
        except ValueError:
            if kind == "docx":
                raise
            raise ValueError("Legacy .doc files are not supported; save as .docx or .pdf") from None
    raise ValueError(f"Unsupported file extension: .{kind}")


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files below a path as rows: path, file_name, file_type, file_size, sha256, content."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.select("path", name.alias("file_name"), F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).alias("file_type"), F.col("length").alias("file_size"), F.sha2("content", 256).alias("sha256"), "content")


def accepted(files: DataFrame) -> DataFrame:
    return files.where(F.lower("file_type").isin(*ACCEPTED))


def extract_texts(files: DataFrame, pdf: PdfReader | None = None, ocr: OcrProvider | None = None, native: bool = False) -> DataFrame:
    """Each file's text or error: path, text, method, page counts, error."""

    kinds = {"path": pa.string(), "text": pa.string(), "method": pa.string(), "text_pages": pa.int32(), "ocr_pages": pa.int32(), "total_pages": pa.int32(), "error": pa.string()}

    def sent(out: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in out], t) for k, t in kinds.items()], names=list(kinds))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One file is taken out of its batch at a time, and texts are sent on as they come."""
        out, chars = [], 0
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                name = path.as_py()
                try:
                    out.append({"path": name, **extracted(name, content.as_py(), pdf, ocr, native)})
                except Exception as e:  # a bad file is a result, not a failed task
                    out.append({"path": name, "error": str(e)})
                chars += len(out[-1].get("text") or "")
                if len(out) >= SENT_FILES or chars >= SENT_CHARS:
                    yield sent(out)
                    out, chars = [], 0
        if out:
            yield sent(out)

    return files.select("path", "content").mapInArrow(task, "path string, text string, method string, text_pages int, ocr_pages int, total_pages int, error string")


def landed(files: DataFrame, job_id: str, path: str) -> DataFrame:
    """Keeps raw files as Parquet, partitioned by job, and returns their résumé rows. A file without an
    extension counts as PDF; a file that the job keeps already isn't kept twice, so a rerun changes nothing."""
    spark = files.sparkSession
    kind = F.when(F.coalesce("file_type", F.lit("")) == "", "pdf").otherwise(F.lower("file_type"))
    named = accepted(files.withColumn("file_type", kind))
    rows = named.withColumn("job_id", F.lit(job_id)).withColumn("id", F.sha2(F.concat_ws(":", F.lit(job_id), "file_name", "sha256"), 256)).dropDuplicates(["id"])
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    new = rows
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        kept = spark.read.schema(rows.schema).parquet(path).where(F.col("job_id") == job_id).select("id")
        new = rows.join(kept, "id", "left_anti").select(*rows.columns)
    new.write.mode("append").partitionBy("job_id").parquet(path)
    return rows.select("id", "job_id", "file_name", F.col("path").alias("file_path"), "file_type", "file_size", F.lit("pending").alias("status"), F.current_timestamp().alias("uploaded_at"))
