"""Benchmark decontamination with one Aho-Corasick automaton over the windows of test items."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopcat.llm.common import discard, written

WINDOW = 10  # words in a row that count as taken from an item
AUTOMATON = 100_000  # windows of one automaton, which takes some 100 bytes for each of their words
LETTERS = 1_100_000  # characters that can stand for a word

#: Bytes of normalised text: A-Z in lower case, any other ASCII but digits and letters a space, UTF-8 beyond it as it is.
_NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case, in UTF-8."""
    return (text or "").encode().translate(_NORMAL).split()


def windows(items: DataFrame, item_col: str, text_cols: tuple[str, ...], size: int) -> DataFrame:
    """(window binary, item string): distinct windows of the items' texts, each text by itself.

    A window is ``size`` consecutive words, joined by spaces; a text of fewer words, but not none, is one.
    """
    texts = items.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
        F.explode(F.array(*[F.col(c).cast("string") for c in text_cols])).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = words(text.as_py())
                for at in range(0, len(found), 1 << 16):
                    out = [b" ".join(found[k:k + size]) for k in range(at, min(at + (1 << 16), max(len(found) - size + 1, 1)))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(out, pa.binary()), pa.array([item] * len(out), pa.string())], ["window", "item"])

    return texts.mapInArrow(cut, "window binary, item string").distinct()


class Finder:
    """The automaton. Each word of a window is one character, so that it steps through a text word by word."""

    def __init__(self, rows: list[tuple[bytes, str]]):
        self.letters: dict[bytes, str] = {}
        self.items: list[list[str]] = []
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        known: dict[bytes, int] = {}
        for window, item in rows:
            if window not in known:
                known[window] = len(self.items)
                self.items.append([])
                key = "".join([self._letter(w) for w in window.split(b" ")])
                self.automaton.add_word(key, known[window])
            self.items[known[window]].append(item)
        self.sizes = [window.count(b" ") + 1 for window in known]
        self.automaton.make_automaton()

    def _letter(self, word: bytes) -> str:
        n = len(self.letters) + 1  # 0 is any word that no window has
        return self.letters.setdefault(word, chr(n if n < 0xD800 else n + 0x800))

    def occurrences(self, found: list[bytes]) -> list[tuple[int, int, int]]:
        """(first word, word after the last, window) of every occurrence, overlapping ones too."""
        if not self.items:
            return []
        letter = self.letters.get
        text = "".join([letter(w, "\0") for w in found])
        return [(end + 1 - self.sizes[w], end + 1, w) for end, w in self.automaton.iter(text)]


_FINDERS: dict[str, Finder] = {}  # the last automaton of this Python worker, by the name of its windows


def _finder(patterns: Broadcast) -> Finder:
    name, rows = patterns.value
    if name not in _FINDERS:
        _FINDERS.clear()
        _FINDERS[name] = Finder(rows)
    return _FINDERS[name]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching word ranges as one."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def _places(text: str, ranges: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Word ranges as ranges of code points of the original text."""
    if not ranges:
        return []
    raw = text.encode()
    normal = np.frombuffer(raw.translate(_NORMAL), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate([[False], normal, [False]]).astype(np.int8)))
    before = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [{"start": int(before[edges[2 * a]]), "stop": int(before[edges[2 * b - 1]])} for a, b in ranges]


_HITS = "struct<ranges: array<struct<start: long, stop: long>>, items: array<string>>"
_RANGES = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_HITS_ARROW = pa.struct([("ranges", _RANGES), ("items", pa.list_(pa.string()))])
_RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<start: long, stop: long>>"


def _scan(rows: DataFrame, patterns: Broadcast, last: bool) -> DataFrame:
    """Add the occurrences of one automaton's windows to ``hits``, or return the result of all automata.

    ``rows`` is (id, text, hits). The text is scanned once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(patterns)
        for batch in batches:
            n_words, ranges, items, spans = [], [], [], []
            for text, before in zip(batch.column("text"), batch.column("hits").to_pylist()):
                text = text.as_py()
                found = words(text)
                seen = finder.occurrences(found)
                hit = [(a, b) for a, b, _ in seen] + [(r["start"], r["stop"]) for r in before["ranges"]]
                own = {i for w in {w for _, _, w in seen} for i in finder.items[w]}.union(before["items"])
                hit = _merged(hit)
                n_words.append(len(found))
                ranges.append([{"start": a, "stop": b} for a, b in hit])
                items.append(sorted(own))
                if last:
                    spans.append(_places(text, hit))
            if last:
                n_hit = [sum(r["stop"] - r["start"] for r in hit) for hit in ranges]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                     pa.array(items, pa.list_(pa.string())), pa.array(spans, _RANGES)],
                    ["id", "n_words", "n_hit", "items", "spans"])
            else:
                hits = pa.StructArray.from_arrays([pa.array(ranges, _RANGES), pa.array(items, pa.list_(pa.string()))],
                                                  fields=list(_HITS_ARROW))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), hits], ["id", "text", "hits"])

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"id {kind}, {_RESULT}" if last else f"id {kind}, text string, hits {_HITS}")


def decontaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_texts: tuple[str, ...] = ("text",), size: int = WINDOW, automaton: int = AUTOMATON,
) -> DataFrame:
    """Which words of each text stand inside a run of ``size`` words that a test item has too.

    Returns id, n_words, n_hit, items (ids of the items with occurring windows, sorted as strings), spans (what
    is hit, as ranges of code points of the original text; touching ranges are one). ``item_texts`` may
    name several columns, such as question and answer; no window spans two of them. A text of an item with fewer
    words, but not none, is one window.

    All windows go to every task as one Aho-Corasick automaton, which scans every whole text once. Their
    number is counted first: beyond ``automaton`` they are dealt to several automata, one after the other, each
    scanning a written table of the texts, so that a task never holds more than one.

    Null texts have no words. Equal windows of several items count for each. Repeated rows of documents are rows of
    their own; repeated items are one. An item without an id appears as an empty string. An empty
    benchmark hits nothing, and an empty table of documents gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    found = written(windows(items, item_col, item_texts, size), "windows")
    parts = max(1, -(-found.count() // min(automaton, LETTERS // size)))
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
        F.struct(F.array().cast("array<struct<start: long, stop: long>>").alias("ranges"),
                 F.array().cast("array<string>").alias("items")).alias("hits"))
    for part in range(parts):
        # About ``automaton`` rows of a few dozen bytes at most.
        mine = found.where(F.pmod(F.xxhash64("window", "item"), F.lit(parts)) == part)
        patterns = spark.sparkContext.broadcast(
            (uuid.uuid4().hex, [(bytes(r["window"]), r["item"]) for r in mine.collect()]))
        last = part == parts - 1
        rows = _scan(rows, patterns, last) if last else written(_scan(rows, patterns, last), "scanned")
    discard(found)
    return rows
