"""BPE encoding and decoding through a table of distinct words."""

from __future__ import annotations

import gc
import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from tokenizers import Tokenizer

from shopcat.llm.common import and_column

CHUNK = 8 << 20  # characters of text that share one list of distinct words
BUCKETS = (256, 8192)  # least and most parts of the distinct-word table, by a hash of the word

# The pattern of words and the special tokens of word_bpe_49k.json.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")  # the same, of printable ASCII in lower case
SPECIAL = re.compile(r"(<\|startoftext\|>|<\|endoftext\|>)")

ODD_SPACE = re.compile("[\x1c-\x1f]")  # str.split() parts texts here, the tokenizer does not
PLAIN_SPACE = re.compile(r"[^ \t\n\r\x0b\x0c]+")


class Splitter:
    """Words of a text: units between spaces, then the tokenizer's own normalizer and pattern."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)

    def units(self, text: str) -> list[str]:
        return PLAIN_SPACE.findall(text) if ODD_SPACE.search(text) else text.split()

    def words(self, unit: str) -> list[str]:
        if unit.isascii():
            if unit.isalpha():
                return [unit.lower()]
            if unit.isprintable() and "<|" not in unit:  # the normalizer lowers these and does nothing else
                return ASCII_WORDS.findall(unit.lower())
        end = unit[-1:] if unit[-1:] in ".,!?;:" else ""
        core = unit[: len(unit) - len(end)]
        if core.isalpha() and (core.isascii() or (
                "Σ" not in core and "İ" not in core and unicodedata.is_normalized("NFC", core))):
            return [core.lower(), end] if end else [core.lower()]
        out = []
        for part in SPECIAL.split(unit):
            if SPECIAL.fullmatch(part):
                out.append(part)
            elif part:
                out += WORDS.findall(self.tokenizer.normalizer.normalize_str(part))
        return out

    def encode(self, words: list[str]) -> list[str]:
        """Ids of each word. Printable ASCII stands for itself in the byte alphabet of the model."""
        merge, whole, out = self.tokenizer.model.tokenize, self.tokenizer.encode, []
        for word in words:
            if word.isascii() and word.isprintable() and "<|" not in word:
                out.append(" ".join([str(token.id) for token in merge(word)]))
            else:
                out.append(" ".join(map(str, whole(word, add_special_tokens=False).ids)))
        return out


def uncollected(run: Callable) -> Callable:
    """A task without cyclic garbage collection, which would look through all words at hand again and again."""
    def quiet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()

    return quiet


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Rows in chunks of about ``CHUNK`` characters; a longer text is a chunk of its own."""
    for batch in batches:
        ids, texts, first, size = batch.column(0), _texts(batch.column(1)), 0, 0
        for at, text in enumerate(texts):
            if size and size + len(text) > CHUNK:
                yield ids[first:at], texts[first:at]
                first, size = at, 0
            size += len(text)
        if first < len(texts):
            yield ids[first:], texts[first:]


def _chunk_key(ids: pa.Array, texts: list[str]) -> bytes:
    digest = xxhash.xxh3_128()
    for id_, text in zip(ids.to_pylist(), texts):
        digest.update(f"{id_} {len(text)} ".encode())
        digest.update(text.encode())
    return digest.digest()


def _vocabulary(texts: Iterable[list[str]], split: Splitter, buckets: int) -> tuple[dict[str, list[str]], dict[int, list[str]]]:
    """(words of each distinct unit, sorted distinct words by bucket) of a chunk, whose texts are given as units."""
    seen, words_of = set(), split.words
    for own in texts:
        seen.update(own)
    units = {unit: words_of(unit) for unit in seen}
    found: dict[int, list[str]] = {}
    for word in set(chain.from_iterable(units.values())):
        found.setdefault(xxhash.xxh3_64_intdigest(word.encode()) % buckets, []).append(word)
    for words in found.values():
        words.sort()
    return units, found


def _zip(text: str) -> bytes:
    return zstandard.compress(text.encode(), 3)


def _unzip(data: bytes) -> list[str]:
    return zstandard.decompress(data).decode().split("\n")


def encode_words(uses: DataFrame, path: str) -> DataFrame:
    """(chunk, bucket, ids): ids of the words of each chunk, from the table of distinct words.

    ``uses`` has (bucket, chunk, words): the sorted distinct words of a chunk that hash to the bucket. All
    uses of a word meet in its bucket, where it is encoded once. A task holds the distinct words of one
    bucket at a time.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, bucket, table = Splitter(path), None, {}
        for batch in batches:
            out = []
            for at, words in zip(batch.column("bucket").to_pylist(), batch.column("words").to_pylist()):
                if at != bucket:
                    bucket, table = at, {}
                words = _unzip(words)
                new = [w for w in words if w not in table]
                table.update(zip(new, split.encode(new)))
                out.append(_zip("\n".join(map(table.__getitem__, words))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("chunk"), batch.column("bucket"), pa.array(out, pa.binary())], ["chunk", "bucket", "ids"])

    return uses.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        uncollected(encode), "chunk binary, bucket int, ids binary")


def encode(docs: DataFrame, path: str, finish: Callable, schema: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """Encode every whole text, as the tokenizers library does without special tokens.

    Texts are split into words in chunks. The distinct words of a chunk go to the distinct-word table, which
    is spread by a hash of the word and in which each is encoded once. Their ids come back to the chunk, by a
    join, and take the positions of the words. Only lists of distinct words, of their ids and the
    packed texts are shuffled, no row per word. ``finish(id, ids)`` gets arrays of row ids and id texts
    (decimal ids between single spaces) and returns the arrays of ``schema``.

    Null texts are empty and give no ids. Repeated rows are rows of their own.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = dict(rows.dtypes)["id"]
    buckets = min(BUCKETS[1], max(BUCKETS[0], int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def use(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(path)
        for ids, texts in _chunks(batches):
            found, key = _vocabulary(map(split.units, texts), split, buckets)[1], _chunk_key(ids, texts)
            yield pa.RecordBatch.from_arrays([
                pa.array(list(found), pa.int32()), pa.array([key] * len(found), pa.binary()),
                pa.array([_zip("\n".join(words)) for words in found.values()], pa.binary())], ["bucket", "chunk", "words"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _chunks(batches):
            sink = pa.BufferOutputStream()
            body = pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string())], ["id", "text"])
            with pa.ipc.new_stream(sink, body.schema) as writer:
                writer.write_batch(body)
            yield pa.RecordBatch.from_arrays([
                pa.array([_chunk_key(ids, texts)], pa.binary()),
                pa.array([zstandard.compress(sink.getvalue(), 6)], pa.binary())], ["chunk", "body"])

    def join_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, names = Splitter(path), [f.split()[0] for f in schema.split(",")]
        for batch in batches:
            for k in range(batch.num_rows):
                body = pa.ipc.open_stream(zstandard.decompress(batch.column("body")[k].as_buffer())).read_all()
                ids, texts = body.column("id").combine_chunks(), [split.units(t) for t in _texts(body.column("text"))]
                units, found = _vocabulary(texts, split, buckets)
                table = {}
                for part in batch.column("parts")[k].as_py() or []:
                    table.update(zip(found[part["bucket"]], _unzip(part["ids"])))
                known = {unit: table[words[0]] if len(words) == 1 else " ".join(map(table.__getitem__, words))
                         for unit, words in units.items()}
                done = [" ".join(map(known.__getitem__, own)) for own in texts]
                yield pa.RecordBatch.from_arrays(finish(ids, done), names)

    uses = rows.mapInArrow(uncollected(use), "bucket int, chunk binary, words binary")
    back = encode_words(uses, path).groupBy("chunk", "bucket").agg(F.first("ids").alias("ids")).groupBy("chunk").agg(
        F.collect_list(F.struct("bucket", "ids")).alias("parts"))
    packed = rows.mapInArrow(pack, "chunk binary, body binary")
    return packed.join(back, "chunk", "left").select("chunk", "body", "parts").mapInArrow(
        uncollected(join_back), schema.replace("ID_TYPE", id_type))


def pieces(path: str) -> list[str]:
    """The piece of each id. Its size is the vocabulary's."""
    tokenizer = Tokenizer.from_file(path)
    return [tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]


def decode(ids: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """Add ``decoded``: the pieces of an array of ids, joined by spaces, as this tokenizer decodes.

    The id-to-piece table has the vocabulary's size and goes to every task. Null ids give an empty text;
    ids outside the vocabulary are left out.
    """
    spark = ids.sparkSession
    table = spark.sparkContext.broadcast(pieces(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = table.value
            texts = [" ".join(known[i] for i in row or () if i is not None and 0 <= i < len(known))
                     for row in batch.column(ids_col).to_pylist()]
            yield batch.append_column("decoded", pa.array(texts, pa.string()))

    kept = ids.drop("decoded")
    return kept.mapInArrow(run, and_column(kept, "decoded", StringType()))


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): the ids of every text; see :func:`encode`."""

    def finish(ids: pa.Array, done: list[str]) -> list[pa.Array]:
        return [ids, pa.array([list(map(int, d.split())) for d in done], pa.list_(pa.int32()))]

    return encode(docs, path, finish, "id ID_TYPE, ids array<int>", id_col, text_col)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of ids and of the decoded text.

    The text is decoded from the ids through the id-to-piece table where the ids are put together, so
    that neither ids nor pieces are moved again.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(
        {str(i): piece.encode() for i, piece in enumerate(pieces(path))})

    def finish(ids: pa.Array, done: list[str]) -> list[pa.Array]:
        known, n, encoded_sha, decoded_sha = table.value, [], [], []
        for text in done:
            parts = text.split()
            n.append(len(parts))
            encoded_sha.append(hashlib.sha256(text.encode()).hexdigest())
            decoded_sha.append(hashlib.sha256(b" ".join(map(known.__getitem__, parts))).hexdigest())
        return [ids, pa.array(n, pa.int64()), pa.array(encoded_sha), pa.array(decoded_sha)]

    return encode(
        docs, path, finish, "doc_id ID_TYPE, n_tokens long, ids_sha256 string, decoded_sha256 string",
        id_col, text_col)
