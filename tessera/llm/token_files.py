"""Token files in patched frame-of-reference blocks.

A file holds the ids of a run of documents in ascending document order:

    magic, block payloads, document table (ids, counts), block starts, footer (counts, lengths, magic)

A block of up to BLOCK ids stores its minimum, a bit width chosen so that a given percentile of the ids
less the minimum fits, the packed low bits of all, and an exception list (position, high part) for the
rest. Block starts and document counts let a reader fetch any document by one range read.
"""

from __future__ import annotations

import math
import struct
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import files_at, in_batches, partitions, planned_bytes, small_batches, text_of, work_folder, written
from .tokens import word_ids

MAGIC = b"PFORTOK1"
BLOCK = 4096
PERCENTILE = 95.0
#: Bytes of input, by the planner's estimate, that one file is for; files are no fewer than shuffle partitions.
FILE_BYTES = 128 << 20
#: Bytes before a block's packed words: count u32, minimum u32, width u8, 3 unused, exceptions u32.
HEAD = struct.Struct("<IIBxxxI")
FOOT = struct.Struct("<QQQQ8s")


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """Unsigned values below 2**width, 32 to a group of `width` words."""
    if not width or not len(values):
        return b""
    lanes = np.zeros((-(-len(values) // 32), 32), np.uint64)
    lanes.reshape(-1)[: len(values)] = values
    words = np.zeros((len(lanes), width + 1), np.uint64)
    for j in range(32):
        word, shift = divmod(j * width, 32)
        moved = lanes[:, j] << np.uint64(shift)
        words[:, word] |= moved & np.uint64(0xFFFFFFFF)
        words[:, word + 1] |= moved >> np.uint64(32)
    return words[:, :width].astype("<u4").tobytes()


def unpack_bits(data, n: int, width: int) -> np.ndarray:
    """The n values of pack_bits."""
    if not width or not n:
        return np.zeros(n, np.uint32)
    words = np.frombuffer(data, "<u4").reshape(-1, width).astype(np.uint64)
    words = np.concatenate([words, np.zeros((len(words), 1), np.uint64)], axis=1)
    out = np.empty((len(words), 32), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for j in range(32):
        word, shift = divmod(j * width, 32)
        out[:, j] = ((words[:, word] | words[:, word + 1] << np.uint64(32)) >> np.uint64(shift)) & mask
    return out.reshape(-1)[:n]


def encode_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """A block of 1 to 2**32-1 unsigned 32-bit ids."""
    least = int(ids.min())
    rest = ids - np.uint32(least)
    rank = min(len(rest) - 1, max(0, int(np.ceil(len(rest) * percentile / 100)) - 1))
    width = int(np.partition(rest, rank)[rank]).bit_length()
    high = rest >> np.uint32(width) if width < 32 else np.zeros_like(rest)
    odd = np.flatnonzero(high).astype("<u4")
    low = rest & np.uint32((1 << width) - 1)
    return HEAD.pack(len(ids), least, width, len(odd)) + pack_bits(low, width) + odd.tobytes() + high[odd].astype("<u4").tobytes()


def decode_block(data, at: int = 0) -> tuple[np.ndarray, int]:
    """The ids of the block at a position, and the position behind it."""
    n, least, width, odds = HEAD.unpack_from(data, at)
    at += HEAD.size
    size = -(-n // 32) * 4 * width
    ids = unpack_bits(memoryview(data)[at : at + size], n, width)
    at += size
    if odds:
        where = np.frombuffer(data, "<u4", odds, at)
        ids[where] |= np.frombuffer(data, "<u4", odds, at + 4 * odds) << np.uint32(width)
        at += 8 * odds
    return ids + np.uint32(least), at


class Writer:
    """Appends documents to one token file; holds at most one block of ids, and 13 bytes a document."""

    def __init__(self, out, percentile: float = PERCENTILE):
        self.out, self.percentile, self.at = out, percentile, len(MAGIC)
        self.held, self.size, self.tokens = [], 0, 0
        self.starts, self.docs, self.known, self.counts = array("Q"), array("q"), array("B"), array("I")
        out.write(MAGIC)

    def add(self, doc: int | None, ids: bytes) -> None:
        self.docs.append(doc or 0)
        self.known.append(doc is not None)
        self.counts.append(len(ids) // 4)
        self.tokens += len(ids) // 4
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= 4 * BLOCK:
            data = b"".join(self.held)
            whole = len(data) // (4 * BLOCK) * (4 * BLOCK)
            self._blocks(data[:whole])
            self.held, self.size = [data[whole:]], len(data) - whole

    def _blocks(self, data: bytes) -> None:
        ids = np.frombuffer(data, "<u4")
        for at in range(0, len(ids), BLOCK):
            block = encode_block(ids[at : at + BLOCK], self.percentile)
            self.starts.append(self.at)
            self.at += len(block)
            self.out.write(block)

    def close(self) -> None:
        self._blocks(b"".join(self.held))
        table = np.asarray(self.docs).astype("<i8").tobytes() + self.known.tobytes() + np.asarray(self.counts).astype("<u4").tobytes()
        self.out.write(table + np.array(self.starts, "<u8").tobytes())
        self.out.write(FOOT.pack(self.at, len(self.docs), len(self.starts), self.tokens, MAGIC))
        self.out.close()


class Reader:
    """Reads a token file by ranges: the footer and tables once, then blocks as they are needed."""

    def __init__(self, source):
        self.source = source
        end = source.size() - FOOT.size
        self.end, n, blocks, self.tokens, magic = FOOT.unpack(source.read_at(FOOT.size, end))
        if magic != MAGIC:
            raise ValueError("not a token file")
        table = source.read_at(end - self.end, self.end)
        self.docs = np.frombuffer(table, "<i8", n)
        self.known = np.frombuffer(table, np.uint8, n, 8 * n)
        self.counts = np.frombuffer(table, "<u4", n, 9 * n).astype(np.int64)
        self.starts = np.append(np.frombuffer(table, "<u8", blocks, 13 * n).astype(np.int64), self.end)
        self.firsts = np.cumsum(self.counts) - self.counts

    def ids(self, first: int, n: int) -> np.ndarray:
        """The ids from a position in the file on, by one range read."""
        if not n:
            return np.zeros(0, np.uint32)
        a, b = first // BLOCK, (first + n - 1) // BLOCK + 1
        data = self.source.read_at(int(self.starts[b] - self.starts[a]), int(self.starts[a]))
        at, found = 0, []
        for _ in range(a, b):
            block, at = decode_block(data, at)
            found.append(block)
        return np.concatenate(found)[first - a * BLOCK : first - a * BLOCK + n]

    def documents(self, run: int = 256 * BLOCK):
        """(doc_id, first, ids) of all, reading about `run` ids at a time."""
        at = 0
        while at < len(self.docs):
            to = max(at + 1, int(np.searchsorted(self.firsts, self.firsts[at] + run)))
            base = int(self.firsts[at])
            ids = self.ids(base, int(self.firsts[to - 1] + self.counts[to - 1]) - base)
            for k in range(at, to):
                first = int(self.firsts[k])
                yield (int(self.docs[k]) if self.known[k] else None), first, ids[first - base : first - base + int(self.counts[k])]
            at = to


def write_token_files(df: DataFrame, tokenizer: str, folder: str, *, id_column: str = "doc_id", text_column: str = "text", end_id: int = 2, percentile: float = PERCENTILE, files: int | None = None) -> DataFrame:
    """Encodes every text, appends the end id, and writes files in ascending document order.

    Returns the manifest, a table in `folder`: file (0, 1, ... in document order), path, documents, tokens,
    base (tokens of all files before it). Only files that the manifest names count; a task that is run
    again writes another file, and the manifest names the one of the attempt that was committed.

    Null text counts as empty: its document is the end id alone. Null ids come first. Repeated ids are
    neighbours, their texts in ascending order. Other columns are ignored. An empty table gives an empty
    manifest. Texts are shuffled once, by ranges of the id; a task holds one block of ids. Without `files` their
    number follows the size of the input, a file for FILE_BYTES, so that a task's share doesn't grow with it.
    """
    spark = df.sparkSession
    small_batches(spark)
    n = files or max(partitions(spark), math.ceil(planned_bytes(df, text_column) / FILE_BYTES))

    def encode(batches):
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        ids, end, part, writer = word_ids(tokenizer), end_id.to_bytes(4, "little"), TaskContext.get().partitionId(), None
        system, place = files_at(folder)
        name = f"tokens-{part:05d}-{uuid.uuid4().hex}.pfor"
        for batch in batches:
            if batch.num_rows and writer is None:
                system.create_dir(f"{place}/files", recursive=True)
                writer = Writer(system.open_output_stream(f"{place}/files/{name}"), percentile)
            for doc, own in zip(batch.column(0).to_pylist(), ids.encode_batch(batch.column(1))):
                writer.add(doc, own + end)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{folder}/files/{name}"], "documents": pa.array([len(writer.docs)], pa.int64()), "tokens": pa.array([writer.tokens], pa.int64())})

    ordered = df.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    parts = written(ordered.mapInArrow(encode, "part int, path string, documents long, tokens long"), f"{folder}/parts")
    order = W.orderBy("part")  # a row for each file
    return parts.select((F.row_number().over(order) - 1).alias("file"), "path", "documents", "tokens", (F.sum("tokens").over(order) - F.col("tokens")).alias("base"))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Every document of a manifest's files: doc_id, file, start (tokens of all documents before it), ids.

    ids are little-endian unsigned 32-bit integers, the end id among them. Null ids, repeated ids and empty texts come
    back as rows of their own, as they were written; a manifest without rows gives no rows. Columns of the manifest
    other than file, path and base don't matter. A task reads about a million ids at a time.
    """

    def decode(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("file", pa.int32()), ("start", pa.int64()), ("ids", pa.binary())])

        def rows():
            for batch in batches:
                for file, path, base in zip(*(batch.column(k).to_pylist() for k in range(3))):
                    system, place = files_at(path)
                    with system.open_input_file(place) as source:
                        for doc, first, ids in Reader(source).documents():
                            yield doc, file, base + first, ids.astype("<u4").tobytes()

        yield from in_batches(rows(), schema, weigh=lambda r: len(r[3]) + 40)

    spread = manifest.select("file", "path", "base").repartition(partitions(manifest.sparkSession))
    return spread.mapInArrow(decode, "doc_id long, file int, start long, ids binary")


def token_files(df: DataFrame, tokenizer: str, **options) -> DataFrame:
    """write_token_files into a new folder, then read_token_files."""
    return read_token_files(write_token_files(df, tokenizer, work_folder(df.sparkSession, "tokens"), **options))
