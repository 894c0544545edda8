"""Pages as bytes: files or columns of fetched bytes, decoded by mark, header or declaration."""

from __future__ import annotations

import codecs
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The decoder travels with its job: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
_PRESCAN = 1024  # bytes in which a page has to declare its charset
_COMMENT = re.compile(rb"<!--.*?(?:-->|\Z)", re.S)
_DECLARED = re.compile(
    rb"""<meta\b[^>]*?\bcharset\s*=\s*["']?\s*([a-z0-9_:.-]+)|<\?xml\b[^>]*?\bencoding\s*=\s*["']([a-z0-9_:.-]+)""", re.I)
_HEADER = re.compile(r"""charset\s*=\s*["']?\s*([a-z0-9_:.-]+)""", re.I)
_TEXT = re.compile(r"utf-(8|16|16-le|16-be|32)|ascii|iso8859-\d+|cp\d+|koi8-[a-z]|mac-\w+|big5\w*|gb\w+|euc_\w+|shift_jis\w*|iso2022_\w+|tis-620|johab")


def codec(label: str | None) -> str | None:
    """Name of the codec a charset label means; null for labels that are unknown or not charsets of texts."""
    try:
        name = codecs.lookup(label).name if label else ""
    except (LookupError, ValueError):
        return None
    return name if _TEXT.fullmatch(name) else None


def charset_of(page: bytes, content_type: str | None = None) -> tuple[str, int]:
    """(codec, length of the byte order mark): by mark, ``content_type``, declaration in the page, else UTF-8.

    A label that is unknown is passed over. A declaration that could be read byte by byte can't be in UTF-16,
    so one that says so means UTF-8.
    """
    for mark, name in _MARKS:
        if page.startswith(mark):
            return name, len(mark)
    header = _HEADER.search(content_type or "")
    told = codec(header.group(1)) if header else None
    if told is None:
        for found in _DECLARED.finditer(_COMMENT.sub(b"", page[:_PRESCAN])):
            told = codec((found.group(1) or found.group(2)).decode("ascii"))
            if told is not None:
                told = "utf-8" if told.startswith(("utf-16", "utf-32")) else told
                break
    return told or "utf-8", 0


def decode_pages(pages: DataFrame, content: str = "content", content_type: str | None = None,
                 slice_bytes: int = 4_000_000) -> DataFrame:
    """Replace the bytes of ``content`` by ``html`` and ``charset``; other columns pass through.

    One row in, one row out, no shuffle, batch or stream. ``content_type`` names a column with the
    header of the response. Bytes that are not valid in the charset become U+FFFD; null bytes give a null page
    and charset, and empty ones an empty page. Batches that leave are cut by ``slice_bytes``.
    """
    kept = [f for f in pages.schema.fields if f.name not in (content, "html", "charset")]
    schema = T.StructType([*kept, T.StructField("html", T.StringType()), T.StructField("charset", T.StringType())])
    names, out_names = [f.name for f in kept], schema.names

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, begin = batch.column(content), 0
            headers = batch.column(content_type) if content_type else None
            while begin < batch.num_rows:
                texts, charsets, size, end = [], [], 0, begin
                while end < batch.num_rows and size < slice_bytes:
                    page = source[end].as_py()
                    if page is None:
                        texts.append(None)
                        charsets.append(None)
                    else:
                        name, skip = charset_of(page, headers[end].as_py() if headers is not None else None)
                        texts.append(page[skip:].decode(name, "replace"))
                        charsets.append(name)
                        size += len(page)
                    size += 1
                    end += 1
                rest = [batch.column(c).slice(begin, end - begin) for c in names]
                yield pa.RecordBatch.from_arrays(
                    [*rest, pa.array(texts, pa.string()), pa.array(charsets, pa.string())], names=out_names)
                begin = end

    return pages.mapInArrow(decode, schema)


def _page_rows(files: DataFrame, urls: DataFrame | None) -> DataFrame:
    rows = decode_pages(files.select("path", F.col("modificationTime").alias("retrieved_time"), "content"))
    if urls is not None:
        named = urls.select(F.col("file").alias("_file"), F.col("url").alias("_url"))
        rows = rows.join(named, F.substring_index("path", "/", -1) == F.col("_file"), "left")
    url = F.coalesce(F.col("_url"), F.col("path")) if urls is not None else F.col("path")
    return rows.select(F.xxhash64("path").alias("page_id"), url.alias("url"), "html", "charset", "retrieved_time")


def read_page_files(spark: SparkSession, path: str, urls: DataFrame | None = None, **options: str) -> DataFrame:
    """Files of fetched pages as pages: ``page_id, url, html, charset, retrieved_time``.

    A page's time is that of its file, its id a hash of the path. ``urls`` (file, url; one row per file)
    gives the address a file name was fetched from; a file without one has its path for an address.
    """
    return _page_rows(spark.read.format("binaryFile").options(**options).load(path), urls)


def stream_page_files(
    spark: SparkSession, path: str, urls: DataFrame | None = None, max_files: int = 10_000, **options: str,
) -> DataFrame:
    """The same as a stream over new files, ``max_files`` per batch; ``urls`` is joined as a static table."""
    files = spark.readStream.format("binaryFile").schema(
        "path string, modificationTime timestamp, length bigint, content binary")
    return _page_rows(files.options(maxFilesPerTrigger=max_files, **options).load(path), urls)
