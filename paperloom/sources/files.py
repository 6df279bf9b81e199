"""Files as rows: type sniffing, upload checks, decoding and the page lists of readers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Leading bytes (hex) of the accepted types, the size and page limits, and the OCR threshold.
SIGNATURES = [("255044462D", "application/pdf"), ("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff")]
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
ALLOWED = ["application/pdf", "image/png", "image/jpeg", "image/tiff", "image/webp", "text/plain", DOCX]
MAX_BYTES, MAX_PAGES, OCR_BELOW = 20 * 1024 * 1024, 50, 120
#: Charsets tried in turn; the last never fails.
CHARSETS = ["utf-8", "utf-8-sig", "cp1250", "iso-8859-2", "latin-1"]

PAGES = T.ArrayType(T.StructType([T.StructField("number", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("used_ocr", T.BooleanType())]))


def looks_like_text(content: Column) -> Column:
    """Valid UTF-8 without NUL, over nine tenths printable."""
    valid = F.is_valid_utf8(F.when(F.length(content) > 0, content).cast("string"))
    t = F.try_validate_utf8(content.cast("string"))
    odd = F.length(F.regexp_replace(t, r"[^\p{C}\p{Zl}\p{Zp}[\p{Zs}&&[^ ]]]|[\r\n\t]", ""))
    return F.coalesce((F.length(content) > 0) & valid & ~t.contains("\x00") & ((F.length(t) - odd) / F.length(t) > 0.9), F.lit(False))


def sniff_type(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 2048))
    found = F.when(head.startswith("504B0304"), F.when(head.contains(b"word/".hex().upper()), DOCX))
    for sig, mime in SIGNATURES:
        found = found.when(head.startswith(sig), mime)
    found = found.when(head.startswith(b"RIFF".hex()), F.when(F.substring(head, 17, 8) == b"WEBP".hex().upper(), "image/webp"))
    return found.when(looks_like_text(content), "text/plain")


def type_mismatch(declared: Column, sniffed: Column) -> Column:
    return F.trim(F.split(declared, ";")[0]) != sniffed


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_bytes, content, content_type, checksum_sha256) of the files under a path."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", F.col("length").alias("size_bytes"), "content", sniff_type(F.col("content")).alias("content_type"), F.sha2("content", 256).alias("checksum_sha256"))


def check_uploads(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """files with `reject`: why an upload is refused, or null."""
    why = F.when(F.col("size_bytes") == 0, "empty_document").when(F.col("size_bytes") > max_bytes, "file_too_large").when(~F.coalesce(F.col("content_type").isin(*ALLOWED), F.lit(False)), "unsupported_file_type")
    return files.withColumn("reject", why)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for raw in batch["content"].to_pylist():
            for charset in CHARSETS:
                try:
                    out.append(None if raw is None else raw.decode(charset))
                    break
                except UnicodeDecodeError:
                    continue
        keep = [c for c in batch.schema.names if c != "content"]
        yield pa.RecordBatch.from_pydict({c: batch[c] for c in keep} | {"text": pa.array(out, pa.string())})


def read_plain(files: DataFrame) -> DataFrame:
    """files (path, content) -> (path, text): the first charset that decodes; valid UTF-8 stays in the JVM."""
    rows = files.select("path", "content", F.is_valid_utf8(F.col("content").cast("string")).alias("utf8"))
    good = rows.where("utf8").select("path", F.col("content").cast("string").alias("text"))
    other = rows.where("not utf8 or utf8 is null").select("path", "content").mapInArrow(_decoded, "path string, text string")
    return good.unionByName(other)


#: Readers of page lists by type; one gets (content) and yields (text, used_ocr) pages. None is bundled.
READERS: dict[str, Callable[[bytes], list[tuple[str, bool]]]] = {}


class TooManyPages(Exception):
    """A file of more than MAX_PAGES pages."""

    code = "too_many_pages"


def register_reader(content_type: str, reader: Callable[[bytes], list[tuple[str, bool]]]) -> None:
    READERS[content_type] = reader


def read_pages(files: DataFrame) -> DataFrame:
    """files (path, content, content_type) -> (path, pages, error) by the registered readers."""
    readers = dict(READERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages, errors = [], []
            for raw, kind in zip(batch["content"].to_pylist(), batch["content_type"].to_pylist(), strict=True):
                try:
                    found = readers[kind](raw)
                    pages.append([{"number": i + 1, "text": t, "used_ocr": o} for i, (t, o) in enumerate(found)])
                    errors.append(None if found else "empty_document")
                except KeyError:
                    pages.append(None)
                    errors.append("text_extraction_failed")
                except Exception as e:  # noqa: BLE001 - a reader's failure is a row's error
                    pages.append(None)
                    errors.append(getattr(e, "code", "corrupt_document"))
            kind = pa.list_(pa.struct([("number", pa.int32()), ("text", pa.string()), ("used_ocr", pa.bool_())]))
            yield pa.RecordBatch.from_pydict({"path": batch["path"], "pages": pa.array(pages, kind), "error": pa.array(errors, pa.string())})

    return files.select("path", "content", "content_type").mapInArrow(run, T.StructType([T.StructField("path", T.StringType()), T.StructField("pages", PAGES), T.StructField("error", T.StringType())]))


def join_pages(pages: Column) -> Column:
    """Non-blank pages, a blank line between."""
    return F.array_join(F.filter(F.transform(pages, lambda p: F.trim(p["text"])), lambda t: t != ""), "\n\n")


def needs_ocr(pages: Column, below: int = OCR_BELOW) -> Column:
    """Numbers of the pages with too little native text."""
    return F.transform(F.filter(pages, lambda p: F.length(F.trim(p["text"])) < below), lambda p: p["number"])


def accept_ocr(native: Column, ocr: Column) -> Column:
    """OCR text stands only where it is the longer."""
    return F.when(F.length(F.trim(ocr)) > F.length(F.trim(native)), ocr).otherwise(native)


def routed(pages: DataFrame, ocr: Callable[[DataFrame], DataFrame], below: int = OCR_BELOW) -> DataFrame:
    """pages (path, number, text, ...) -> (path, pages): pages with little native text go to ocr, alone, and come back in order.

    ocr gets (path, number, text) of those and gives (path, number, ocr): null, or no row, where it failed. What it read stands only where it
    is longer than what was there; a failure costs nothing but the page's OCR.
    """
    native = pages.select("path", "number", F.coalesce("text", F.lit("")).alias("text"))
    sparse = native.where(F.length(F.trim("text")) < below)
    read = ocr(sparse).select(F.col("path").alias("__path"), F.col("number").alias("__number"), "ocr")
    both = native.join(read, F.col("path").eqNullSafe(F.col("__path")) & (F.col("number") == F.col("__number")), "left")
    taken = F.length(F.trim("ocr")) > F.length(F.trim("text"))
    page = F.struct("number", F.when(taken, F.col("ocr")).otherwise(F.col("text")).alias("text"), F.coalesce(taken, F.lit(False)).alias("used_ocr"))
    return both.groupBy("path").agg(F.sort_array(F.collect_list(page)).alias("pages"))  # MAX_PAGES at most


#: The keys of a PDF's information that are kept, and characters of each.
PDF_KEYS, PDF_VALUE = ["title", "author", "producer", "creator", "creationdate", "moddate"], 200


def pdf_metadata(meta: Column) -> Column:
    """The kept keys in lower case, their values cut to length; empty values are left out."""
    kept = F.map_filter(meta, lambda k, v: F.lower(k).isin(*PDF_KEYS) & (v != ""))
    return F.transform_values(F.transform_keys(kept, lambda k, v: F.lower(k)), lambda k, v: F.substring(v, 1, PDF_VALUE))
