"""Token ids as directly addressable codes, in token files that give any token without decoding a block.

An id is cut into chunks of the level widths, low bits first. Level 0 holds the first chunk of every id and a bitmap of
those that go on; level 1 holds the second chunks of only these, and so on. A directory of set bits before each
RANK_BITS bits of a bitmap turns a place in one level into the place in the next.

A token file is a Parquet table with one row for each segment of whole documents (SEGMENT_TOKENS ids or one long
document): part and seq give the segments' order, before the ids ahead of a segment in its part, doc_ids and counts its documents, payload the codes.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEVEL_BITS = (9, 7, 16)
RANK_BITS = 512
SEGMENT_TOKENS = 1 << 18
END_ID = 0
#: Words whose ids a worker keeps; beyond it a word is encoded each time.
CACHE_WORDS = 1_000_000
#: Words up to this length are kept with the signs after them too, as they come often.
SHORT = 10
#: Texts that are encoded together.
TEXTS_AT_ONCE = 256
MAGIC = b"DAC1"


def _pack(values: np.ndarray, width: int) -> bytes:
    octets = values.astype("<u2").view(np.uint8).reshape(-1, 2)
    return np.packbits(np.unpackbits(octets, axis=1, bitorder="little")[:, :width], bitorder="little").tobytes()


def _unpack(data: memoryview, width: int, n: int) -> np.ndarray:
    # a chunk of 16 bits or less lies within three bytes
    octets = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(2, np.uint8)]).astype(np.uint32)
    first = np.arange(n, dtype=np.int64) * width
    words = (octets[:-2] | octets[1:-1] << np.uint32(8) | octets[2:] << np.uint32(16))[first >> 3]
    return words >> (first & 7).astype(np.uint32) & np.uint32((1 << width) - 1)


def dump(ids: np.ndarray, level_bits: tuple[int, ...] = LEVEL_BITS) -> bytes:
    """Codes of unsigned ids below 2 ** sum(level_bits); levels that no id reaches are left out."""
    rest = np.asarray(ids, np.uint64)
    if len(rest) and int(rest.max()) >> sum(level_bits):
        raise ValueError("an id is too large for the levels")
    levels, body = [], []
    for n, width in enumerate(level_bits):
        over = rest >> np.uint64(width)
        goes_on = over > 0
        last = n == len(level_bits) - 1 or not goes_on.any()
        body.append(_pack(rest & np.uint64((1 << width) - 1), width))
        if not last:
            body.append(np.packbits(goes_on, bitorder="little").tobytes())
            ones = np.add.reduceat(goes_on, np.arange(0, len(goes_on), RANK_BITS), dtype=np.uint32)
            body.append((np.cumsum(ones, dtype=np.uint32) - ones).astype("<u4").tobytes())
        levels.append((width, len(rest)))
        rest = over[goes_on]
        if last:
            break
    return MAGIC + struct.pack("<I", len(levels)) + b"".join(struct.pack("<IQ", *x) for x in levels) + b"".join(body)


class Codes:
    """Reads codes: len(), [i] by rank alone, and all() ids."""

    def __init__(self, data: bytes) -> None:
        data = memoryview(data)
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        (n,) = struct.unpack_from("<I", data, 4)
        self.levels, at = [], 8 + 12 * n
        for k in range(n):
            width, count = struct.unpack_from("<IQ", data, 8 + 12 * k)
            sizes = [-(-count * width // 8), -(-count // 8), -(-count // RANK_BITS) * 4] if k < n - 1 else [-(-count * width // 8), 0, 0]
            parts = []
            for size in sizes:
                parts.append(data[at : at + size])
                at += size
            self.levels.append((width, count, *parts))

    def __len__(self) -> int:
        return self.levels[0][1]

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        out, shift = 0, 0
        for width, _, chunks, bitmap, ranks in self.levels:
            first = i * width
            word = int.from_bytes(chunks[first // 8 : (first + width + 7) // 8], "little")
            out |= (word >> first % 8 & (1 << width) - 1) << shift
            if not len(bitmap) or not bitmap[i // 8] >> i % 8 & 1:
                return out
            begin = i // RANK_BITS * RANK_BITS
            between = int.from_bytes(bitmap[begin // 8 : i // 8 + 1], "little") & (1 << i - begin) - 1
            i = struct.unpack_from("<I", ranks, i // RANK_BITS * 4)[0] + between.bit_count()
            shift += width
        return out

    def all(self) -> np.ndarray:
        out = np.zeros(len(self), np.uint32)
        at, shift = slice(None), 0
        for width, count, chunks, bitmap, _ in self.levels:
            value = _unpack(chunks, width, count)
            out[at] |= value << np.uint32(shift)
            if not len(bitmap):
                break
            more = np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8), count=count, bitorder="little"))
            at = more if isinstance(at, slice) else at[more]
            shift += width
        return out


class WordEncoder:
    """Encodes texts by a byte-level BPE tokenizer of the tokenizers library, one distinct word at a time.

    Its pre-tokenizer always breaks before a lone space or newline that stands between other characters, and between a
    letter and the signs of TAIL after it. So a text with no other white space is the sequence of its words, each with
    the space before it, and a word's ids can be kept. Any other text, and one that holds an added token, is encoded
    whole.
    """

    TAIL = ".,;:!?#$%&*|"

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kept: dict[bool, dict[str, bytes]] = {True: {}, False: {}}  # by whether a space stands before the word
        self.tails: dict[str, bytes] = {}
        self.newline = self._whole("\n")
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, n in self.tokenizer.get_vocab().items():
            self.spaced[n] = token.startswith("\u0120")  # how the vocabulary spells a space

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _new(self, spaced: list[str], bare: list[str]) -> dict[bool, dict[str, bytes]]:
        """Ids of words that are not kept; those after a space are encoded as one text and parted at their spaces."""
        out: dict[bool, dict[str, bytes]] = {True: {}, False: {}}
        if spaced:
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(spaced)], add_special_tokens=False)[0].ids, "<u4")
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) != len(spaced):
                raise AssertionError("a word does not begin with one token of a space")
            data, ends = ids.tobytes(), (4 * np.append(starts[1:], len(ids))).tolist()
            out[True] = {w: data[a:b] for w, a, b in zip(spaced, (4 * starts).tolist(), ends)}
        if bare:
            out[False] = {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(bare, self.tokenizer.encode_batch_fast(bare, add_special_tokens=False))}
        for space, kept in self.kept.items():
            if len(kept) < CACHE_WORDS:
                kept.update(out[space])
        return out

    def _parts(self, chunk: str, space: bool) -> list[tuple[str, str, bool]] | None:
        """(word, tail, space before) of the lines of a chunk between spaces; null if there is other white space."""
        out = []
        for line in chunk.split("\n"):
            if line.split() != [line]:
                return None
            word = line.rstrip(self.TAIL)
            out.append((word, line[len(word) :], space) if word and word[-1].isalpha() else (line, "", space))
            space = False
        return out

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; nothing for a null or empty text."""
        get = self.kept[True].get
        out: list = []
        rare: list[tuple[list, int, list]] = []  # places that the kept words do not fill, with their parts
        missing: dict[bool, dict[str, None]] = {True: {}, False: {}}
        for text in texts:
            if not text:
                out.append([b""])
                continue
            if len(text.split()) != text.count(" ") + text.count("\n") + 1 or any(a in text for a in self.added):
                out.append([self._whole(text)])
                continue
            chunks = text.split(" ")
            ids = list(map(get, chunks))
            ids[0] = None
            at, own_rare = -1, len(rare)
            for _ in range(ids.count(None)):
                at = ids.index(None, at + 1)
                chunk = chunks[at]
                if at and "\n" not in chunk:
                    word = chunk.rstrip(self.TAIL)
                    own, tail = get(word), self.tails.get(chunk[len(word) :])
                    if own and tail and word[-1].isalpha():
                        ids[at] = own + tail
                        if len(chunk) <= SHORT and len(self.kept[True]) < CACHE_WORDS:
                            self.kept[True][chunk] = ids[at]
                        continue
                parts = self._parts(chunk, at > 0)
                if parts is None:
                    del rare[own_rare:]
                    ids = [self._whole(text)]
                    break
                rare.append((ids, at, parts))
                for word, tail, space in parts:
                    if word not in self.kept[space]:
                        missing[space][word] = None
                    if tail and tail not in self.tails:
                        self.tails[tail] = self._whole(tail)
            out.append(ids)
        new = self._new(list(missing[True]), list(missing[False]))
        for ids, at, parts in rare:
            ids[at] = self.newline.join((self.kept[space].get(word) or new[space][word]) + (self.tails[tail] if tail else b"") for word, tail, space in parts)
        if len(self.tails) > 10_000:
            self.tails.clear()
        return [b"".join(x) for x in out]


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _writer(path: str, end_id: int, level_bits: tuple[int, ...], segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, seq = _encoder(path), TaskContext.get().partitionId(), 0
        end = struct.pack("<I", end_id)
        doc_ids, held, size, before = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            row = [[part], [seq], [before], [len(ids)], [doc_ids], [[len(x) // 4 for x in held]], [dump(ids, level_bits)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], ["part", "seq", "before", "n_tokens", "doc_ids", "counts", "payload"])

        for batch in (b.slice(n, TEXTS_AT_ONCE) for b in batches for n in range(0, b.num_rows, TEXTS_AT_ONCE)):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode_all(batch.column("text").to_pylist())):
                ids += end
                if held and size + len(ids) > 4 * segment:
                    yield flush()
                    seq, before, doc_ids, held, size = seq + 1, before + size // 4, [], [], 0
                doc_ids.append(doc_id)
                held.append(ids)
                size += len(ids)
        if held:
            yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, order: tuple[Column, ...] | None = None, end_id: int = END_ID, level_bits: tuple[int, ...] = LEVEL_BITS, segment: int = SEGMENT_TOKENS) -> None:
    """Writes the ids of every whole text, each with end_id after it, as a token file in ascending order.

    order is ascending doc_id unless given; nulls come first, repeated rows follow each other. A null or empty text has
    the end id alone. An empty table gives a file without segments. Columns other than doc_id and text are ignored.
    """
    order = order or (F.col("doc_id"),)
    keys = [f"order_{n}" for n in range(len(order))]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[c.alias(k) for c, k in zip(order, keys)])
    # rows that share all keys, as those without an id do, are told apart by their text and then by a draw
    rows = rows.withColumn("crc", F.crc32(F.coalesce("text", F.lit("")))).withColumn("drawn", F.xxhash64(F.monotonically_increasing_id()))
    rows = rows.repartitionByRange(*keys, "crc", "drawn").sortWithinPartitions(*keys, "crc").select("doc_id", "text")
    kinds = "part int, seq int, before long, n_tokens long, doc_ids array<long>, counts array<long>, payload binary"
    rows.mapInArrow(_writer(tokenizer, end_id, level_bits, segment), kinds).write.option("compression", "none").parquet(path)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = Codes(row["payload"]).all()
            ends = np.cumsum(row["counts"])
            starts = ends - row["counts"]
            crcs = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(starts, ends)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["start"], pa.int64()), pa.array(row["counts"], pa.int64()), pa.array(crcs, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a token file with `start`, the ids of all segments before each."""
    rows = spark.read.parquet(path)
    # one row for each task that wrote, which is what Spark's driver keeps of tasks anyway
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    parts = parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("parts_before"))
    return rows.join(F.broadcast(parts), "part").withColumn("start", F.col("parts_before") + F.col("before")).drop("parts_before", "before")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document of a token file, from its codes."""
    rows = segments(spark, path).select("start", "doc_ids", "counts", "payload")
    return rows.mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
