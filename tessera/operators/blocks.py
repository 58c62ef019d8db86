"""Byte columns as tables of blocks: split, encode in parallel, reassemble in order, and read at random."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.codec import block_decode, block_encode
from tessera.kernels import batch as many
from tessera.kernels import block


def split(df: DataFrame, data: str, size: int = 64 << 10, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each `size` bytes of a byte column: keep's columns, block_no, block_offset, raw. Empty cells give one empty block, null ones none."""
    raw = F.col(data).cast("binary")
    last = F.greatest(F.floor((F.octet_length(raw) - 1) / F.lit(size)), F.lit(0)).cast("int")
    each = df.where(F.col(data).isNotNull()).select(*keep, raw.alias("whole"), F.explode(F.sequence(F.lit(0), last)).alias("block_no"))
    at = F.col("block_no").cast("long") * size
    return each.select(*keep, "block_no", at.alias("block_offset"), F.substring("whole", at.cast("int") + 1, F.lit(size)).alias("raw"))


def encode(blocks: DataFrame, acceleration: int = 1, level: int = 0, dictionary: bytes = b"") -> DataFrame:
    """Adds packed, raw_size, packed_size and stored (the block would grow, so it is kept as it is)."""
    packed = blocks.withColumn("packed", block_encode("raw", acceleration, level, dictionary))
    grows = F.octet_length("packed") >= F.octet_length("raw")
    return packed.select("*", F.octet_length("raw").alias("raw_size"), F.least(F.octet_length("packed"), F.octet_length("raw")).alias("packed_size"), grows.alias("stored"))


def decode(blocks: DataFrame, dictionary: bytes = b"") -> DataFrame:
    """Adds back, the bytes of packed, and ok, whether they are raw."""
    back = blocks.withColumn("back", block_decode("packed", dictionary=dictionary))
    return back.withColumn("ok", F.coalesce(F.col("back") == F.col("raw"), F.lit(False)))


def assemble(blocks: DataFrame, keys: list[str], data: str = "raw", order: str = "block_no", whole: bool = True) -> DataFrame:
    """keys, data, blocks and error: one row for each key with its blocks joined in order.

    Numbers must follow one another, from 0 if the key is to be whole. A missing, repeated or null block gives null data and an
    error that says so. A key's blocks meet in one task, so keys are files or documents, not whole corpora.
    """
    numbers = F.sort_array(F.collect_list(order))
    joined = blocks.groupBy(*keys).agg(
        F.expr(f"listagg(`{data}`, X'') WITHIN GROUP (ORDER BY `{order}`)").alias("_data"), numbers.alias("_numbers"), F.count("*").alias("blocks"), F.count(data).alias("_known")
    )
    first, n = F.lit(0) if whole else F.col("_numbers")[0], F.size("_numbers")
    expected = F.transform("_numbers", lambda x, i: x == first + i)
    error = (
        F.when((n < F.col("blocks")) | (F.col("_known") < F.col("blocks")), "a null block")
        .when(F.size(F.array_distinct("_numbers")) < n, "a repeated block").when(~F.forall(expected, lambda x: x), "a missing block")
    )
    return joined.withColumn("error", error).select(*keys, F.when(F.col("error").isNull(), F.coalesce("_data", F.lit(b""))).alias(data), "blocks", "error")


def offsets(blocks: DataFrame, keys: list[str], size: str, order: str = "block_no") -> DataFrame:
    """Adds `offset`, the sum of the sizes of the blocks before."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return blocks.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long"))


def covering(blocks: DataFrame, start, length, size: int, number: str = "block_no") -> DataFrame:
    """Only the blocks that hold bytes [start, start + length): a filter that partitions and files can be pruned by."""
    a, n = (x if isinstance(x, Column) else F.lit(x) for x in (start, length))
    return blocks.where((n > 0) & F.col(number).between(F.floor(a / F.lit(size)), F.floor((a + n - 1) / F.lit(size))))


def read_range(blocks: DataFrame, keys: list[str], start: int, length: int, size: int, dictionary: bytes = b"") -> DataFrame:
    """Bytes [start, start + length) of each key, decoding only the blocks that hold them; null where one of these can't be decoded."""
    few = covering(blocks, start, length, size).withColumn("raw", block_decode("packed", dictionary=dictionary))
    first = start // size * size
    few = few.withColumn("block_no", F.col("block_no") - F.lit(start // size))
    return assemble(few, keys).select(*keys, F.expr(f"substring(raw, {start - first + 1}, {length})").alias("slice"))


def _by_key(rows: DataFrame) -> DataFrame:
    """Rows dealt by own_key to as many tasks as shuffles have: joined to parts of so many bytes they would be few, and these are bound by CPU."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "own_key")


def _tail(messages: list[bytes], fresh: list[bool], before: bytes, window: int) -> bytes:
    """The last bytes of the stream that goes on behind these messages."""
    new = max((k for k, f in enumerate(fresh) if f), default=-1)
    return b"".join(messages[new:] if new >= 0 else [before, *messages])[-window:]


def linked_streams(df: DataFrame, key: str, order: str, data: str, level: int = 0, window: int = block.HISTORY, dictionary: bytes = b"") -> DataFrame:
    """Each key's messages, in order, packed with up to 64 KB of the messages before as history: key, order, seq, packed, raw_size.

    seq numbers a key's messages from 0; it is the order that unlinked_streams needs, also where `order` repeats. A dictionary
    is what precedes every key's first message. The state of a key is its history alone; its messages come sorted and a batch at a time, so a
    long stream isn't held as a whole. Null messages count as empty.
    """
    kinds = dict(df.dtypes)

    def run(batches):
        now, history, seq = None, b"", 0
        for batch in batches:
            messages, fresh, numbers = [bytes(m) for m in batch["message"]], [], []
            for own in batch["own_key"]:
                fresh.append(now is None or own != now[0])
                now, seq = (own,), 0 if fresh[-1] else seq + 1
                numbers.append(seq)
            if window == block.HISTORY:  # the dictionary is indexed once for all streams of a piece
                packed = many.encode_streams(messages, fresh, level=level, dictionary=dictionary, before=history)
                history = _tail(messages, fresh, history, window)
            else:
                packed = []
                for message, new in zip(messages, fresh):
                    history = dictionary[-window:] if new else history
                    packed.append(block.encode(message, level=level, history=history))
                    history = (history + message)[-window:]
            yield pd.DataFrame({"own_key": batch["own_key"], "own_order": batch["own_order"], "seq": numbers, "packed": packed, "raw_size": [len(m) for m in messages]})

    rows = df.select(F.col(key).alias("own_key"), F.col(order).alias("own_order"), F.coalesce(F.col(data).cast("binary"), F.lit(b"")).alias("message"))
    ordered = _by_key(rows).sortWithinPartitions("own_key", "own_order", "message")
    out = ordered.mapInPandas(run, f"own_key {kinds[key]}, own_order {kinds[order]}, seq long, packed binary, raw_size int")
    return out.select(F.col("own_key").alias(key), F.col("own_order").alias(order), "seq", "packed", "raw_size")


def unlinked_streams(df: DataFrame, key: str, order: str, window: int = block.HISTORY, dictionary: bytes = b"") -> DataFrame:
    """The messages of linked_streams' rows: key, order, seq, message. Rows may come in any order, and from files."""
    kinds = dict(df.dtypes)

    def run(batches):
        now, history = None, b""
        for batch in batches:
            packed, fresh = [bytes(p) for p in batch["packed"]], []
            for own in batch["own_key"]:
                fresh.append(now is None or own != now[0])
                now = (own,)
            found = []
            for first, last in many.pieces([len(p) for p in packed]):
                some, new = packed[first:last], fresh[first:last]
                # What the first one continues is a block of literals before it.
                lead = [] if new[0] or not history else [block._write(history, 0, [])]
                back = many.decode_streams(lead + some, [True] * len(lead) + new, dictionary[-window:]) if window == block.HISTORY else None
                if back is None:
                    back, held = [], history
                    for p, start in zip(some, new):
                        held = b"" if start else held
                        back.append(block.decode(p, history=(dictionary + held)[-window:]))
                        held = (held + back[-1])[-window:]
                else:
                    back = back[len(lead) :]
                history = _tail(back, new, history, window)
                found += back
            yield pd.DataFrame({"own_key": batch["own_key"], "own_order": batch["own_order"], "seq": batch["seq"], "message": found})

    rows = df.select(F.col(key).alias("own_key"), F.col(order).alias("own_order"), "seq", "packed")
    ordered = _by_key(rows).sortWithinPartitions("own_key", "seq")
    out = ordered.mapInPandas(run, f"own_key {kinds[key]}, own_order {kinds[order]}, seq long, message binary")
    return out.select(F.col("own_key").alias(key), F.col("own_order").alias(order), "seq", "message")


def match_candidates(df: DataFrame, key: str, data: str, size: int = 4) -> DataFrame:
    """How many places of each cell have bytes that occurred before in it: key, places, repeats. Counted by 4-grams, not pair by pair.

    Cells meet by key once, and a key's distinct grams are held while its cells come by: grams themselves aren't shuffled. `size` is 8 at most.
    """
    import pyarrow as pa

    if not 1 <= size <= 8:
        raise ValueError("size must be 1 to 8 bytes")
    kinds = dict(df.dtypes)

    def run(batches):
        now, places, seen = None, 0, []
        for batch in batches:
            keys, out = batch.column(0).to_pylist(), []
            for k, own in enumerate(keys):
                if now is not None and not _same(own, now[0]):
                    out.append((now[0], places, places - len(_distinct(seen))))
                    places, seen = 0, []
                now = (own,)
                grams = _grams(batch.column(1)[k].as_py(), size)
                places += len(grams)
                seen.append(grams)
                if len(seen) > 1 and sum(map(len, seen[1:])) >= len(seen[0]):
                    seen = [_distinct(seen)]
            yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate((batch.schema.field(0).type, pa.int64(), pa.int64()))], names=["own_key", "places", "repeats"])
            kind = batch.schema.field(0).type
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]], kind), pa.array([places], pa.int64()), pa.array([places - len(_distinct(seen))], pa.int64())], names=["own_key", "places", "repeats"])

    raw = F.col(data).cast("binary")
    rows = df.where(F.octet_length(raw) >= size).select(F.col(key).alias("own_key"), raw.alias("data"))
    ordered = _by_key(rows).sortWithinPartitions("own_key")
    return ordered.mapInArrow(run, f"own_key {kinds[key]}, places long, repeats long").withColumnRenamed("own_key", key)


def _same(a, b) -> bool:
    """Whether keys are one group's: nulls are, and so are numbers that are none."""
    return a == b or (a is not None and b is not None and a != a and b != b)


def _grams(data: bytes, size: int) -> np.ndarray:
    """The bytes from each place on, as numbers."""
    words = np.ndarray((len(data) - size + 1,), "<u8", data + bytes(8), strides=(1,))
    return words & np.uint64((1 << 8 * size) - 1)


def _distinct(grams: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(grams))


def fold_hash(blocks: DataFrame, keys: list[str], data: str = "raw", order: str = "block_no", bits: int = 32, seed: int = 0) -> DataFrame:
    """keys and `hash` of each key's blocks one after another: the hash of the whole, which is never joined.

    Sorted batches stream through a task that holds one hash state at a time.
    """
    import xxhash

    make = xxhash.xxh32 if bits == 32 else xxhash.xxh64
    kinds = dict(blocks.dtypes)

    def run(batches):
        now, state = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                if row[:-1] != now:
                    if now is not None:
                        out.append((*now, state.intdigest()))
                    now, state = row[:-1], make(seed=seed)
                state.update(bytes(row[-1]))
            yield pd.DataFrame(out, columns=[*keys, "hash"])
        if now is not None:
            yield pd.DataFrame([(*now, state.intdigest())], columns=[*keys, "hash"])

    rows = blocks.select(*keys, F.col(order).alias("_order"), F.coalesce(F.col(data).cast("binary"), F.lit(b"")).alias("_data"))
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "_order").select(*keys, "_data")
    kind = "long" if bits == 32 else "decimal(20,0)"
    if bits == 64:
        inner = run
        def run(batches):  # noqa: E306
            from decimal import Decimal

            for frame in inner(batches):
                yield frame.assign(hash=[Decimal(int(h)) for h in frame["hash"]])

    return ordered.mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", hash {kind}")


def sequence_rows(df: DataFrame, key: str, packed: str) -> DataFrame:
    """key, seq_no, lit_len, offset, match_len of every sequence of every block, as arrays of a piece of a batch; null blocks have none."""
    import pyarrow as pa

    kinds = dict(df.dtypes)

    def run(batches):
        for batch in batches:
            data = batch.column(1)
            known = np.flatnonzero(np.asarray(data.is_valid()))
            for first, last in many.pieces([data[int(k)].as_buffer().size for k in known]):
                some = known[first:last]
                cells = [data[int(k)].as_py() for k in some]
                found = many.sequences_many(cells)
                if found is None:  # a damaged one is told by its error
                    each = [(k, s.seq_no, len(s.literals), s.offset or 0, s.match_len or 0) for k, c in enumerate(cells) for s in block.sequences(c)]
                    found = np.array(each, np.int64).T
                own, number, literals, offset, length = found
                none = offset == 0
                columns = [batch.column(0).take(pa.array(some[own])), *(pa.array(x.astype(np.int32)) for x in (number, literals)), *(pa.array(x.astype(np.int32), mask=none) for x in (offset, length))]
                yield pa.RecordBatch.from_arrays(columns, names=["own_key", "seq_no", "lit_len", "offset", "match_len"])

    rows = df.select(F.col(key).alias("own_key"), F.col(packed).alias("data"))
    return rows.mapInArrow(run, f"own_key {kinds[key]}, seq_no int, lit_len int, offset int, match_len int").withColumnRenamed("own_key", key)
