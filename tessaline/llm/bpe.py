"""BPE encoding and decoding over one table of distinct words.

1. Every task splits its documents into words and packs them in blocks of some
   megabytes: the block's distinct words, and each document as positions in it.
2. The blocks' words meet in parts by word hash: one table of the corpus's distinct
   words, in which each is encoded once.  Its ids go back to the blocks.  The
   number of parts grows with the input, so that a part's words stay few.
3. A block's ids are joined to its documents' words by position.

Decoding joins ids with the table of pieces, whose size the tokenizer bounds and
whose place for a piece is its id.

Words, blocks and ids travel packed, so that shuffles stay below the size of the
texts.  Any number of blocks may hold one word, but only once each, so frequent
words make no hot keys.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from .common import broadcast_checked, materialize, plan_bytes, releasing

BLOCK_CHARS = 14 << 20
#: The distinct words are dealt in so many parts for every PART_BYTES of input.
WORD_PARTS = 64
PART_BYTES = 64 << 30
MOST_PARTS = 1 << 16
#: A task numbers its blocks from its own number, shifted by so many bits.
BLOCK_BITS = 24
#: A block's documents leave the task in slices of so many.
SLICE_DOCS = 256
#: Characters on which normalisation is lower-casing and white space only.
_PLAIN = regex.compile(r"[^\u0000-ɏ‐-‧]")
_SPACE = "\\t-\\r \\x85\\xa0"

_loaded: dict[str, WordBpe] = {}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class WordBpe:
    """A word-level BPE tokenizer file: splitting, encoding a word, and pieces."""

    def __init__(self, spec_json: str):
        spec = json.loads(spec_json)
        self.tokenizer = Tokenizer.from_str(spec_json)
        self.model = self.tokenizer.model
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(pattern.replace(r"[^\s", "[^" + _SPACE)).findall
        from tokenizers import Regex

        self.splitter = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self.symbols = byte_symbols()

    def words(self, text: str) -> list[str]:
        """The words of a text, in order; a special token's string is a word of its own."""
        if self.special_split is None or not any(s in text for s in self.specials):
            return self._words(text)
        found: list[str] = []
        for i, piece in enumerate(self.special_split.split(text)):
            found += [piece] if i % 2 else self._words(piece)
        return found

    def _words(self, text: str) -> list[str]:
        if _PLAIN.search(text) is None:
            return self.find(text.lower())
        return [w for w, _ in self.splitter.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))]

    def encode_word(self, word: str) -> list[int]:
        if word in self.specials:
            return [self.specials[word]]
        symbols = self.symbols
        return [t.id for t in self.model.tokenize("".join([symbols[b] for b in word.encode()]))]


def loaded(spec, key: str) -> WordBpe:
    """This worker's tokenizer for a broadcast file; ``key`` tells files apart."""
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = WordBpe(spec.value)
    return _loaded[key]


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of integers, each as byte planes, which compress well."""
    parts = [np.array([len(arrays)], np.int64).tobytes()]
    for a in arrays:
        width = 8 if a.dtype.itemsize == 8 else 4
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, width).T.copy()
        parts += [np.array([len(a), width], np.int64).tobytes(), planes.tobytes()]
    return zstandard.ZstdCompressor(level=7).compress(b"".join(parts))


def _unpack(packed: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    at, arrays = 8, []
    for _ in range(int(np.frombuffer(raw, np.int64, 1)[0])):
        n, width = (int(x) for x in np.frombuffer(raw, np.int64, 2, at))
        planes = np.frombuffer(raw, np.uint8, n * width, at + 16).reshape(width, n)
        arrays.append(np.ascontiguousarray(planes.T).reshape(-1).view(np.int64 if width == 8 else np.uint32))
        at += 16 + n * width
    return arrays


def _block_rows(block: int, ids: list, counts: list[int], numbers: _Numbers, sequence: list[np.ndarray], parts: int) -> Iterator[tuple]:
    known = np.array([i is not None for i in ids], np.uint32)
    values = np.array([0 if i is None else i for i in ids], np.int64)
    text = np.concatenate(sequence) if sequence else np.zeros(0, np.uint32)
    # Words are placed by part, then by themselves; texts count them by frequency, which packs better.
    listed = list(numbers)
    part_of = [crc32(w.encode()) % parts for w in listed]
    placed = sorted(range(len(listed)), key=lambda n: (part_of[n], listed[n]))
    place = np.zeros(len(listed), np.uint32)
    place[placed] = np.arange(len(listed), dtype=np.uint32)
    by_use = np.argsort(-np.bincount(text, minlength=len(listed)), kind="stable")
    rank = np.zeros(len(listed), np.uint32)
    rank[by_use] = np.arange(len(listed), dtype=np.uint32)
    yield "text", block, -1, _pack(known, values, np.array(counts, np.uint32), place[by_use], rank[text])
    compress = zstandard.ZstdCompressor(level=9).compress
    for p, found in groupby(placed, key=part_of.__getitem__):
        yield "words", block, p, compress(" ".join([listed[n] for n in found]).encode())  # words hold no white space


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids`` with ids as little-endian unsigned 32-bit integers.

    ``decoded`` adds what :func:`decode` would, looked up in the same worker.

    As ``Tokenizer.encode(text, add_special_tokens=False).ids``.  One row per row
    of ``docs``, repeated rows included; a null text is empty and has no ids, a
    null id stays null, texts of any length are encoded whole, an empty table
    gives no rows, and other columns aren't read.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec_json = f.read()
    key = xxhash.xxh3_128_hexdigest(spec_json)
    spec = broadcast_checked(spark, spec_json, len(spec_json.encode()), "the tokenizer file")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    word_parts = min(MOST_PARTS, WORD_PARTS * max(1, -(-plan_bytes(texts) // PART_BYTES)))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec, key)
        base = TaskContext.get().partitionId() << BLOCK_BITS
        schema = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("part", pa.int32()), ("payload", pa.binary())])
        made = 0
        ids, counts, numbers, sequence, size = [], [], _Numbers(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = list(_block_rows(base + made, ids, counts, numbers, sequence, word_parts))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                found = bpe.words(text.as_py() or "")
                ids.append(doc_id)
                counts.append(len(found))
                sequence.append(np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found)))
                size += sum(map(len, found)) if len(found) < 2 else len(text.as_py())
                if size >= BLOCK_CHARS:
                    yield from flush()
                    made += 1
                    ids, counts, numbers, sequence, size = [], [], _Numbers(), [], 0
        if ids:
            yield from flush()
        _loaded.clear()

    blocks = materialize(texts.mapInArrow(releasing(split), "kind string, block long, part int, payload binary"), "bpe-blocks", "kind")

    def encode_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe, memo = loaded(spec, key), {}  # this task's parts of the table of distinct words
        for pdf in batches:
            out = []
            for packed in pdf["payload"]:
                lists = []
                for word in zstandard.ZstdDecompressor().decompress(packed).decode().split(" "):
                    if (found := memo.get(word)) is None:
                        found = memo[word] = np.array(bpe.encode_word(word), np.uint32)
                    lists.append(found)
                out.append(_pack(np.fromiter(map(len, lists), np.uint32, len(lists)), np.concatenate(lists)))
            yield pd.DataFrame({"block": pdf["block"], "part": pdf["part"], "payload": out})

    encoded = (
        blocks.filter("kind = 'words'")
        .select("part", "block", "payload")
        .repartition("part")
        .mapInPandas(releasing(encode_words), "block long, part int, payload binary")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = {}
        for b in batches:
            parts |= zip(b.column("part").to_pylist(), b.column("payload").to_pylist())
        known, ids, counts, place, sequence = _unpack(parts.pop(-1))  # the texts' row
        lists = [_unpack(parts.pop(p)) for p in sorted(parts)]
        length = np.concatenate([x[0] for x in lists]).astype(np.int64) if lists else np.zeros(0, np.int64)
        tokens = np.concatenate([x[1] for x in lists]) if lists else np.zeros(0, np.uint32)
        del lists
        start = (np.cumsum(length) - length)[place]
        length = length[place]
        ends = np.cumsum(counts.astype(np.int64))
        begins = ends - counts
        for low in range(0, len(ids), SLICE_DOCS):
            at = slice(low, low + SLICE_DOCS)
            out_ids = []
            for begin, end in zip(begins[at], ends[at]):
                at_word = sequence[begin:end]
                n = length[at_word]
                index = np.repeat(start[at_word] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                out_ids.append(tokens[index].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[at], mask=known[at] == 0), pa.array([len(x) // 4 for x in out_ids], pa.int64()), pa.array(out_ids, pa.binary())], names=["doc_id", "n_tokens", "ids"]
            )

    texts = blocks.filter("kind = 'text'").select("block", "part", "payload")
    rows = encoded.unionByName(texts).groupBy("block")
    if not decoded:
        return rows.applyInArrow(releasing(place), "doc_id long, n_tokens long, ids binary")
    shared = _shared_pieces(spark, tokenizer_path)

    def place_and_decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in place(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, _texts(shared.value, b.column(2))], names=["doc_id", "n_tokens", "ids", "decoded"])

    return rows.applyInArrow(releasing(place_and_decode), "doc_id long, n_tokens long, ids binary, decoded string")


def pieces(tokenizer_path: str) -> dict[int, str]:
    """The id-to-piece table of a tokenizer file, special tokens included."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    return {n: piece for piece, n in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}


def _shared_pieces(spark, tokenizer_path: str):
    """The pieces in order of id (null where there is none); the vocabulary bounds them."""
    table = pieces(tokenizer_path)
    column = pa.array([table.get(n) for n in range(max(table) + 1)], pa.string())
    return broadcast_checked(spark, column, column.nbytes, "the id-to-piece table")


def _texts(table: pa.Array, ids: pa.Array) -> pa.Array:
    """Packed ids joined with their pieces, and each row's pieces with spaces between."""
    rows = [np.frombuffer(x.as_py() or b"", "<u4") for x in ids]
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint32)
    known = flat < len(table)
    known[known] = pc.is_valid(table).to_numpy(zero_copy_only=False)[flat[known]]
    ends = np.cumsum([0, *map(len, rows)])
    kept = np.concatenate([[0], np.cumsum(known)])[ends]
    found = table.take(pa.array(flat[known].astype(np.int32)))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), found), " ").cast(pa.string())


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """Adds ``decoded``, as ``Tokenizer.decode(ids, skip_special_tokens=False)``.

    ``encoded`` has ``doc_id, n_tokens, ids``.  This vocabulary has no decoder:
    pieces are parted by spaces.  Ids without a piece are left out; null ids decode
    to "".
    """
    shared = _shared_pieces(encoded.sparkSession, tokenizer_path)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SLICE_DOCS):
                part = b.slice(at, SLICE_DOCS)
                yield pa.RecordBatch.from_arrays([*part.columns, _texts(shared.value, part.column(2))], names=["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(releasing(look_up), "doc_id long, n_tokens long, ids binary, decoded string")


def digests(decoded: DataFrame) -> DataFrame:
    """The digest columns of the query ``op1_bpe``."""
    return decoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )
