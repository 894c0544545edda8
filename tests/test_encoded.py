"""Pages as bytes: charsets, files in batch and as a stream."""

import pytest

from shopcat.operators.extract import heuristic_books
from shopcat.sources.encoded import charset_of, decode_pages, read_page_files, stream_page_files

PAGE = ('<html><head>{meta}<title>Povești și țări</title></head><body><article><h1>Povești și țări</h1>'
        '<ul><li>Editura: Măr</li><li>ISBN: 9780000000019</li></ul></article></body></html>')
FORMS = {
    "plain.html": ("", "utf-8", b""),
    "mark.html": ('<meta charset="iso-8859-2">', "utf-8", b"\xef\xbb\xbf"),
    "latin2.html": ('<meta http-equiv="Content-Type" content="text/html; charset=ISO-8859-2">', "iso-8859-2", b""),
    "big.html": ("", "utf-16-be", b"\xfe\xff"),
    "little.html": ("", "utf-16-le", b"\xff\xfe"),
    "quoted.html": ("<!-- <meta charset=koi8-r> --><meta charset = 'windows-1250' >", "cp1250", b""),
}


def encoded(name):
    meta, codec, mark = FORMS[name]
    text = PAGE.format(meta=meta)
    if codec in ("iso-8859-2", "cp1250"):  # neither has letters with a comma below
        text = text.replace("ș", "ş").replace("ț", "ţ")
    return mark + text.encode(codec)


@pytest.mark.parametrize("page, header, want", [
    (b"", None, ("utf-8", 0)),
    (b"<p>", "text/html; charset=ISO-8859-2", ("iso8859-2", 0)),
    (b"<meta charset=utf-8>", 'text/html; Charset="koi8-r"', ("koi8-r", 0)),
    (b"\xef\xbb\xbf<meta charset=koi8-r>", "text/html; charset=koi8-r", ("utf-8", 3)),
    (b"<meta charset=koi8-r>", "text/html; charset=no-such-set", ("koi8-r", 0)),
    (b"<meta charset=koi8-r>", "text/html", ("koi8-r", 0)),
    (b"<meta charset=utf-16>", None, ("utf-8", 0)),
    (b"<meta charset=rot13><meta charset=base64><meta charset=latin1>", None, ("iso8859-1", 0)),
    (b"<?xml version='1.0' encoding='iso-8859-2'?>", None, ("iso8859-2", 0)),
    (b"<!--" + b" " * 2000 + b"<meta charset=koi8-r>", None, ("utf-8", 0)),
    (b" " * 1100 + b"<meta charset=koi8-r>", None, ("utf-8", 0)),
    (b"<meta charset=\xff>", None, ("utf-8", 0)),
])
def test_charset(page, header, want):
    assert charset_of(page, header) == want


def test_decoded_rows(spark):
    rows = [(1, None, None, "a"), (2, b"", None, "b"), (3, b"\xff\xfe<\x00", None, "c"), (4, b"a\xffb", None, "d"),
            (5, "ţ".encode("iso-8859-2"), "text/html; charset=iso-8859-2", "e")]
    df = spark.createDataFrame(rows, "page_id long, body binary, kind string, html string")
    for size in (1, 4_000_000):
        got = decode_pages(df, "body", "kind", slice_bytes=size).orderBy("page_id")
        assert got.columns == ["page_id", "kind", "html", "charset"]
        assert [(r["html"], r["charset"]) for r in got.collect()] == [
            (None, None), ("", "utf-8"), ("<", "utf-16-le"), ("a�b", "utf-8"), ("ţ", "iso8859-2")]


def test_a_page_in_any_charset_gives_one_book(spark, tmp_path):
    for name in FORMS:
        (tmp_path / name).write_bytes(encoded(name))
    urls = spark.createDataFrame([(n, f"https://www.shop.ro/{n}") for n in list(FORMS)[1:]], "file string, url string")
    pages = read_page_files(spark, str(tmp_path), urls)
    by_file = {r["url"].rsplit("/", 1)[1]: r for r in pages.collect()}
    assert set(by_file) == set(FORMS) and by_file["plain.html"]["url"].startswith("file:")
    assert by_file["mark.html"]["url"] == "https://www.shop.ro/mark.html" and by_file["mark.html"]["retrieved_time"]
    books = heuristic_books(pages).select("title", "isbn", "publisher").collect()
    comma_less = {(r["title"].replace("ş", "ș").replace("ţ", "ț"), r["isbn"], r["publisher"]) for r in books}
    assert len(books) == len(FORMS) and comma_less == {("Povești și țări", "9780000000019", "Măr")}


def test_page_files_as_a_stream(spark, tmp_path):
    files = tmp_path / "in"
    files.mkdir()
    query = None
    for name in FORMS:
        (files / name).write_bytes(encoded(name))
        query = (
            stream_page_files(spark, str(files), max_files=1).writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
            .start(str(tmp_path / "out")))
        assert query.awaitTermination(120)
    streamed = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(streamed.collect()) == sorted(read_page_files(spark, str(files)).collect())
