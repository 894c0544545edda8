"""Cross-tokenizer alignment: where two tokenizers cut a text at the same byte, and which tokens meet there."""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shopcat.llm.common import discard, written

CHUNK = 4 << 20  # characters of text whose links are counted together before the shuffle
KNOWN = 550_000  # units whose alignment a Python worker remembers, some 450 bytes each
AT_ONCE = 16_384  # units whose tokens and spans are held at a time
SPACE_MARK = "▁"  # stands for a space in sentencepiece pieces

_CUT = re.compile(r"(?<=\S) (?=\S)")
_TAIL = re.compile(r"(?<=[A-Za-z])[.,;:!?\n]")  # a word ends here for the usual pattern of byte-level BPE


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable Latin-1 stands for itself; the other bytes, in order, for U+0100 and on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    odd = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(odd)}


def _whole(data: bytes) -> bool:
    """Whether a token's bytes are whole characters and don't end in a space, which offsets may leave out."""
    try:
        return bool(data.decode()) and not data.endswith(b" ")
    except UnicodeDecodeError:
        return False


class Unit(NamedTuple):
    """A unit of text as both tokenizers see it, behind a space."""

    n_a: int
    n_b: int
    groups: str  # a1,a2|b1;a3|b2,b3
    links: bytes  # int64s: id of A times the size of B's vocabulary, plus id of B, at each common cut


class Aligner:
    """Both tokenizers, with the bytes of each of their ids. Made once per Python worker."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet, added = byte_alphabet(), self.a.get_added_tokens_decoder()
        size = self.a.get_vocab_size(with_added_tokens=True)
        names = [added[i].content.encode() if i in added else
                 bytes(alphabet[c] for c in self.a.id_to_token(i) or "") for i in range(size)]
        self.bytes_a, self.length_a, self.firm_a = names, self.lengths(names), np.array([_whole(n) for n in names])
        self.width = self.b.get_piece_size()
        self.bytes_b = [self._piece(i) for i in range(self.width)]
        self.length_b = self.lengths(self.bytes_b)
        self.firm_b = np.array([not self.b.is_byte(i) for i in range(self.width)])
        self.text_a, self.text_b = ([str(i) for i in range(len(n))] for n in (self.bytes_a, self.bytes_b))
        self.cuttable = self._cuttable(json.loads(self.a.to_str()))
        self.tails = self.cuttable and not any(_TAIL.search(self.b.id_to_piece(i)) for i in range(self.width))
        self.known: dict[str, Unit | None] = {}

    @staticmethod
    def lengths(names: list[bytes]) -> np.ndarray:
        return np.fromiter(map(len, names), np.int64, len(names))

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace(SPACE_MARK, " ").encode()

    def _cuttable(self, model: dict) -> bool:
        """Whether both tokenizers always cut before a lone space between two words.

        True for byte-level BPE on the usual pattern without normalizer and without added words, and for
        pieces that hold no space but in front. Then the tokens between two such cuts don't depend on the rest.
        """
        split = model["pre_tokenizer"] or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        return bool(plain and not model["normalizer"] and all(t["special"] for t in model["added_tokens"]) and not any(
            SPACE_MARK in self.b.id_to_piece(i).lstrip(SPACE_MARK) for i in range(self.width)))

    def units(self, texts: list[str | None]) -> list[list[str]]:
        """Each text in parts, each of which stands behind a space at which both tokenizers cut."""
        if not self.cuttable:
            return [[t] if t else [] for t in texts]
        split = [t.split(" ") if t else [] for t in texts]
        edges = {u for u in set().union(*split) if not u or len(u.strip()) < len(u)}
        # Such parts show a space beside another white space, or at an end of the text.
        return split if not edges else [own if edges.isdisjoint(own) else _CUT.split(t) for own, t in zip(split, texts)]

    def align(self, units: list[str]) -> list[Unit | None]:
        """Both tokenizers' tokens of each unit and their common cuts; None where a tokenizer loses bytes."""
        spaced = [" " + u for u in units]
        data = [u.encode() for u in spaced]
        codes = self.a.encode_batch(spaced, add_special_tokens=False)
        spans = [p.pieces for p in self.b.encode(units, return_type="proto", num_threads=1)]
        lists_a, lists_b = [c.ids for c in codes], [[p.id for p in own] for own in spans]
        size_a, size_b = self.lengths(lists_a), self.lengths(lists_b)
        ids_a, ids_b = _flat(lists_a), _flat(lists_b)
        text, sizes = b"".join(data), self.lengths(data)
        if not all(b"".join(map(names.__getitem__, ids.tolist())) == text and (_sums(lengths[ids], n) == sizes).all()
                   for names, lengths, ids, n in ((self.bytes_a, self.length_a, ids_a, size_a), (self.bytes_b, self.length_b, ids_b, size_b))):
            good = [k for k, own in enumerate(data) if b"".join([self.bytes_a[i] for i in lists_a[k]]) == own
                    and b"".join([self.bytes_b[i] for i in lists_b[k]]) == own]
            rest = dict(zip(good, self.align([units[k] for k in good]))) if good else {}
            return [rest.get(k) for k in range(len(units))]
        # All units stand one after the other, each from its own byte on.
        start = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        ends_a = self._ends_a(data, codes, ids_a, size_a) + np.repeat(start, size_a)
        ends_b = self._ends_b(spans, ids_b, size_b) + np.repeat(start, size_b)
        _, cut_a, cut_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        owner = np.repeat(np.arange(len(units)), size_a)[cut_a]
        links = (ids_a[cut_a] * self.width + ids_b[cut_b]).tobytes()
        at = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(units)))]).tolist()
        texts = self._groups(ids_a, ids_b, cut_a, cut_b, owner)
        return [Unit(int(a), int(b), ";".join(texts[at[k]:at[k + 1]]), links[8 * at[k]:8 * at[k + 1]])
                for k, (a, b) in enumerate(zip(size_a, size_b))]

    def _groups(self, ids_a: np.ndarray, ids_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, owner: np.ndarray) -> list[str]:
        """The text of each group, for groups in a row."""
        names_a, names_b = [self.text_a[i] for i in ids_a.tolist()], [self.text_b[i] for i in ids_b.tolist()]
        out, from_a, from_b = [], 0, 0
        for to_a, to_b in zip((cut_a + 1).tolist(), (cut_b + 1).tolist()):
            left = names_a[from_a] if to_a - from_a == 1 else ",".join(names_a[from_a:to_a])
            right = names_b[from_b] if to_b - from_b == 1 else ",".join(names_b[from_b:to_b])
            out.append(left + "|" + right)
            from_a, from_b = to_a, to_b
        return out

    def _ends_a(self, data: list[bytes], codes: list, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Byte ends within each unit, from the library's character offsets; see :func:`_refined`."""
        ends = np.array([end for c in codes for _, end in c.offsets], np.int64)
        raw = np.frombuffer(b"".join(data), np.uint8)
        starts = np.flatnonzero((raw & 0xC0) != 0x80)
        if len(starts) < len(raw):
            # Characters are counted through all units, and so are bytes.
            chars = np.fromiter((len(d.decode()) for d in data), np.int64, len(data))
            first = np.concatenate([[0], np.cumsum(chars)])[:-1]
            begin = np.concatenate([[0], np.cumsum(self.lengths(data))])[:-1]
            ends = np.append(starts, len(raw))[ends + np.repeat(first, sizes)] - np.repeat(begin, sizes)
        return _refined(ends, ids, sizes, self.firm_a, self.length_a)

    def _ends_b(self, spans: list, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Byte ends within each unit, from the spans of the pieces, which leave out the first space."""
        ends = np.array([p.end for own in spans for p in own], np.int64) + 1
        return _refined(ends, ids, sizes, self.firm_b, self.length_b)

    def look_up(self, units: list[str]) -> list[Unit | None]:
        """The alignment of distinct units, remembered for later texts.

        A unit with a stop after a letter is put together from what is before and, behind another letter, after it:
        both tokenizers cut there.
        """
        known = self.known
        if len(known) > KNOWN:
            known.clear()
        new, cut = {}, {}  # units to align; units to put together, with their two parts
        for u in units:
            if u not in known:
                m = _TAIL.search(u) if self.tails and not u.isalnum() else None
                if m:
                    word, tail = cut[u] = u[:m.start()], "a" + u[m.start():]
                    if word not in known:
                        new[word] = None
                    if tail not in known:
                        new[tail] = None
                else:
                    new[u] = None
        new = list(new)
        for at in range(0, len(new), AT_ONCE):
            known.update(zip(part := new[at:at + AT_ONCE], self.align(part)))
        tails: dict[str, tuple | None] = {}

        def joined(word: str, tail: str) -> Unit | None:
            if tail not in tails:
                t = known[tail]
                tails[tail] = t and (t.n_a - 1, t.n_b - 1, ";" + t.groups.split(";", 1)[1], t.links[8:])
            w, t = known[word], tails[tail]
            return w and t and Unit(w.n_a + t[0], w.n_b + t[1], w.groups + t[2], w.links + t[3])

        return [joined(*cut[u]) if u in cut else known[u] for u in units]


def _flat(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.int64, sum(map(len, lists)))


def _refined(ends: np.ndarray, ids: np.ndarray, sizes: np.ndarray, firm: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ends of firm tokens as they are, in units of ``sizes`` tokens.

    A token that ends inside a character, a byte token, and one that ends in a space continue from the last
    firm end of the unit, or from its start, by the bytes of the tokens since, as spans can't tell where these end.
    """
    sure = firm[ids]
    if sure.all():
        return ends
    total = np.cumsum(lengths[ids])
    first = np.repeat(np.concatenate([[0], np.cumsum(sizes)])[:-1], sizes)
    last = np.maximum.accumulate(np.where(sure, np.arange(len(ids)), -1))
    begin = np.where(first > 0, total[first - 1], 0)
    return np.where(last >= first, ends[last] - total[last], -begin) + total


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def groups(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, groups): the aligned groups of every text, each with its byte range and the ids of both tokenizers.

    ``groups`` is an array of struct<start, stop, a, b> over the bytes of space + text. Null and empty texts,
    and texts that one of the tokenizers doesn't give back byte for byte, have an empty array.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()),
                               ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        for batch in batches:
            for k in range(batch.num_rows):
                text, out, start = batch.column(1)[k].as_py(), [], 0
                units = both.units([text])[0]
                known = dict(zip(u := list(dict.fromkeys(units)), both.look_up(u)))
                for unit in [known[u] for u in units] if all(known.values()) else []:
                    for group in unit.groups.split(";"):
                        a, b = ([int(i) for i in side.split(",")] for side in group.split("|"))
                        stop = start + int(both.length_a[a].sum())
                        out.append({"start": start, "stop": stop, "a": a, "b": b})
                        start = stop
                yield pa.RecordBatch.from_arrays([batch.column(0)[k:k + 1], pa.array([out], kind)], ["id", "groups"])

    return rows.mapInArrow(
        run, f"id {dict(rows.dtypes)['id']}, groups array<struct<start: long, stop: long, a: array<int>, b: array<int>>>")


def _chunk(both: Aligner, ids: list, texts: list[str | None]) -> tuple[bytes, int, np.ndarray, np.ndarray]:
    """(the texts' results, packed, and the size unpacked; distinct links of all; how often each)."""
    split = both.units(texts)
    units = list(dict.fromkeys(chain.from_iterable(split)))
    found = both.look_up(units)
    place = dict(zip(units, range(len(units))))
    names = [f.groups if f else "" for f in found]
    lost = {u for u, f in zip(units, found) if not f}
    n_a, n_b = (np.array([f[k] if f else 0 for f in found], np.int64) for k in (0, 1))
    rows, uses = [], []
    for id_, own in zip(ids, split):
        if lost and not lost.isdisjoint(own):
            own = []
        places = list(map(place.__getitem__, own))
        at = np.array(places, "<u4")
        sha = hashlib.sha256(";".join(map(names.__getitem__, places)).encode()).hexdigest() if own else ""
        rows.append((id_, int(n_a[at].sum()), int(n_b[at].sum()), sha, len(own)))
        uses.append(at)
    flat = np.concatenate(uses) if uses else np.empty(0, "<u4")
    own = [f.links if f else b"" for f in found]
    sizes, links = (Aligner.lengths(own) // 8).astype("<u4"), np.frombuffer(b"".join(own), np.int64)
    distinct, at = np.unique(links, return_inverse=True)
    times = np.repeat(np.bincount(flat, minlength=len(units)), sizes)
    head = json.dumps([list(zip(*rows)), len(units), len(at)]).encode()
    # Links are kept as places in the chunk's list of distinct links, and texts as places in the list of units.
    body = b"".join([len(head).to_bytes(8, "little"), head, sizes.tobytes(), at.astype("<u4").tobytes(), flat.tobytes()])
    total = np.bincount(at, times, len(distinct)).astype(np.int64)
    return pa.compress(body, "zstd", asbytes=True), len(body), distinct, total


def _open(body: bytes, size: int) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """(columns of the texts, links of each unit, the units' links as places, the texts' units as places)."""
    raw = pa.decompress(body, size, "zstd", asbytes=True)
    start = 8 + int.from_bytes(raw[:8], "little")
    rows, units, links = json.loads(raw[8:start])
    numbers = np.frombuffer(raw[start:], "<u4")
    return rows, numbers[:units], numbers[units:units + links], numbers[units + links:]


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of the given sizes, in whole numbers."""
    ends = np.cumsum(sizes, dtype=np.int64)
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[ends] - total[ends - sizes]


def alignment(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text: tokens of A and B, groups between common cuts, links, and how usual its links are in the corpus.

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. A byte-level BPE encodes
    space + text (A), a sentencepiece model the text (B, which adds the space). Special tokens inside texts
    are plain text. Offsets where a token of A and one of B end cut both into groups; the two tokens that end at a
    cut are a link. A link's count is the number of links of the corpus between the same two ids. ``n_best``
    counts links whose count is the highest of their B id, ties included; ``count_sum`` adds up the counts.

    Texts are tokenized once, in chunks. Where both tokenizers always cut before a lone space, texts are parted there and
    each distinct part of a chunk is tokenized once; see :meth:`Aligner.units`. A chunk is a written row: its texts' results
    and its distinct links with their numbers. Only these distinct links are shuffled, to be summed over the corpus and to
    come back by a join, so a link that every text has is one row for each chunk. The highest count of a B
    id is taken over at most as many rows as A has ids.

    Null and empty texts, and texts that A or B doesn't give back byte for byte, have no tokens: zeros and an
    empty ``groups_sha256``. A text longer than a chunk is a chunk of its own. Repeated rows are rows of
    their own, and count as such. Other columns are not read. ``doc_id`` is returned as a long; null ids stay null.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)

        def packed(ids: list, texts: list) -> pa.RecordBatch:
            body, size, pairs, times = _chunk(both, ids, texts)
            return pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().bytes], pa.binary()), pa.array([body], pa.binary()), pa.array([size], pa.int64()),
                 pa.array([pairs], pa.list_(pa.int64())), pa.array([times], pa.list_(pa.int64()))],
                ["chunk", "body", "size", "pairs", "times"])

        ids, texts, size = [], [], 0
        gc.disable()  # looking for cycles among all remembered units takes a fifth of the time
        try:
            for batch in batches:
                for id_, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    text = text.as_py()
                    if texts and size + len(text or "") > CHUNK:
                        yield packed(ids, texts)
                        ids, texts, size = [], [], 0
                    ids.append(id_)
                    texts.append(text)
                    size += len(text or "")
            if texts:
                yield packed(ids, texts)
        finally:
            gc.enable()

    chunks = written(rows.mapInArrow(
        tokenize, "chunk binary, body binary, size long, pairs array<long>, times array<long>"), "aligned")
    width = aligner(path_a, path_b).width
    uses = chunks.select("chunk", F.explode(F.arrays_zip("pairs", "times")).alias("u")).select(
        "chunk", F.col("u.pairs").alias("pair"), F.col("u.times").alias("times"))
    totals = uses.groupBy("pair").agg(F.sum("times").alias("n"))
    highest = F.max("n").over(Window.partitionBy(F.pmod("pair", F.lit(width))))
    known = totals.withColumn("best", F.col("n") == highest)
    back = uses.select("chunk", "pair").join(known, "pair").groupBy("chunk").agg(
        F.array_sort(F.collect_list(F.struct("pair", "n", "best"))).alias("known"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, sizes, at, uses = _open(batch.column("body")[k].as_py(), batch.column("size")[k].as_py())
                ids, n_a, n_b, shas, parts = rows
                n = np.array(batch.column("n")[k].values or [], np.int64)
                best = np.array(batch.column("best")[k].values or [], np.int64)

                def per_text(of_links: np.ndarray) -> pa.Array:
                    return pa.array(_sums(_sums(of_links, sizes)[uses], np.array(parts)), pa.int64())

                links = per_text(np.ones(len(at), np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), links, links,
                     per_text(best[at]), per_text(n[at]), pa.array(shas, pa.string())], names)

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    schema = ", ".join(f"{n} {'string' if n == 'groups_sha256' else 'long'}" for n in names)
    return chunks.select("chunk", "body", "size").join(back, "chunk", "left").select(
        "body", "size", F.col("known.n").alias("n"), F.col("known.best").alias("best")).mapInArrow(finish, schema)
