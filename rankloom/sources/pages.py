"""PDF extraction by page: a table function turns a file into page rows, and only pages without a usable text layer go to OCR.

The reader gives a file's pages one after another; they are staged as rows, so a page's image is held by no task that
doesn't need it. Quality is a JVM expression over all pages. Pages to be read by OCR are dealt out evenly by (file, page), whatever
file they are from: a file of 10,000 scanned pages is read by all tasks. Texts meet again by file, in page order.

A file that can't be read is a row with an error; a page whose OCR fails keeps what text layer it has, and counts neither as
text nor as OCR page.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.layout import STORED, Layout, combined_pages
from rankloom.functions.text import page_quality, stripped
from rankloom.session import checkpointed
from rankloom.sources.documents import OcrProvider, PdfReader, extract_texts

PAGE = "page_number int, own string, image binary, error string"
NO_TEXT, NO_PAGES = "PDF is scanned or has no extractable text layer", "PDF has no pages"


def file_pages(files: DataFrame, pdf: PdfReader) -> DataFrame:
    """``path``, ``page_number`` (from 1), ``own`` (its text layer), ``image`` and ``error`` of every page; a file that can't be
    read, or has no pages, is one row without a page number."""

    class Pages:
        def eval(self, content: bytes) -> Iterator[tuple]:
            number = 0
            try:
                for number, page in enumerate(pdf(bytes(content)), 1):
                    yield number, page.text, page.image, None
            except Exception as e:  # a bad file is a result, not a failed task
                yield None, None, None, str(e)
                return
            if not number:
                yield None, None, None, NO_PAGES

    pages = F.udtf(Pages, returnType=PAGE)
    return files.lateralJoin(pages(F.col("content").outer())).select("path", "page_number", "own", "image", "error")


def read_by_ocr(pages: DataFrame, ocr: OcrProvider, tasks: int | None = None) -> DataFrame:
    """(path, page_number, read) of pages (path, page_number, image): trimmed text; null where the provider fails or finds none."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        able = ocr.is_available()
        for batch in batches:
            read = []
            for image in batch.column("image").to_pylist():
                try:
                    read.append((ocr.extract_text(image).strip() or None) if able else None)
                except Exception:  # the page keeps its text layer
                    read.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("page_number"), pa.array(read, pa.string())], names=["path", "page_number", "read"])

    spark = pages.sparkSession
    tasks = tasks or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = pages.select("path", "page_number", "image").repartition(tasks, "path", "page_number")
    kind = pages.schema["path"].dataType.simpleString()
    return dealt.mapInArrow(task, f"path {kind}, page_number int, read string")


def pages_with_text(pages: DataFrame, ocr: OcrProvider | None = None, tasks: int | None = None) -> DataFrame:
    """``path``, ``page_number``, ``text`` and ``source`` (text, ocr or none) of pages (path, page_number, own, image)."""
    judged = pages.where("page_number IS NOT NULL").withColumn("usable", page_quality(F.col("own"))["is_usable"])
    if ocr is None:
        met = judged.withColumn("read", F.lit(None).cast("string"))
    else:
        read = read_by_ocr(judged.where("NOT usable AND image IS NOT NULL"), ocr, tasks)
        met = judged.drop("image").join(read, ["path", "page_number"], "left")
    source = F.when(F.col("usable"), "text").when(F.col("read").isNotNull(), "ocr").otherwise("none")
    return met.select("path", "page_number", F.when(F.col("usable"), F.col("own")).otherwise(F.coalesce("read", "own")).alias("text"), source.alias("source"))


def page_counts(pages: DataFrame) -> DataFrame:
    """``text_pages``, ``ocr_pages``, ``total_pages`` and ``method`` (text, ocr, hybrid) of each file, of pages with their ``source``."""
    n = lambda s, name: F.count_if(F.col("source") == s).cast("int").alias(name)
    method = F.when((F.col("text_pages") > 0) & (F.col("ocr_pages") > 0), "hybrid").when(F.col("ocr_pages") > 0, "ocr").otherwise("text")
    return pages.groupBy("path").agg(n("text", "text_pages"), n("ocr", "ocr_pages"), F.count(F.lit(1)).cast("int").alias("total_pages")).withColumn("method", method)


def assembled(pages: DataFrame, layout: Layout | None = STORED) -> DataFrame:
    """One row a file: its pages' texts in order (``combined_pages``), page counts, and an error if there is no text."""
    whole = combined_pages(pages, "path", "page_number", "text", layout)
    met = page_counts(pages).join(whole, "path")
    empty = stripped("text") == ""
    number = lambda c: F.when(~empty, F.col(c)).alias(c)
    return met.select("path", number("text"), number("method"), number("text_pages"), number("ocr_pages"), number("total_pages"), F.when(empty, NO_TEXT).alias("error"))


def extract_by_page(files: DataFrame, pdf: PdfReader, ocr: OcrProvider | None = None, tasks: int | None = None, layout: Layout | None = STORED) -> DataFrame:
    """As ``extract_texts``, with the pages of PDF files as rows: path, text, method, page counts, error."""
    is_pdf = F.lower(F.regexp_extract("path", r"\.([^./\\]*)$", 1)) == "pdf"
    pages = checkpointed(file_pages(files.where(is_pdf), pdf))  # a file is read once
    whole = assembled(pages_with_text(pages, ocr, tasks), layout)
    bad = pages.where("error IS NOT NULL").groupBy("path").agg(F.min("error").alias("bad"))
    # A file that breaks off is an error, whatever pages came before.
    met = whole.join(bad, "path", "full_outer")
    sound = lambda c: F.when(F.col("bad").isNull(), F.col(c)).alias(c)
    told = met.select("path", *(sound(c) for c in ("text", "method", "text_pages", "ocr_pages", "total_pages")), F.coalesce("bad", "error").alias("error"))
    return told.unionByName(extract_texts(files.where(~is_pdf)))
