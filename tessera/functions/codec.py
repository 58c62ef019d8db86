"""Column functions over bytes. Each is an Arrow-batched function: a batch of cells crosses to Python at once.

A null cell gives null. Errors are data: `*_error` functions name them, and decoding in permissive mode
(the default) gives null; in strict mode it raises.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.kernels import batch, block, frames, hashing


def _each(kind: str, call, once: bool = False):
    """A column function that applies call to every cell that isn't null.

    `once` is for costly ones: the planner takes them for not deterministic, or it would make their column anew in each expression that uses it.
    """

    @F.pandas_udf(kind)
    def run(cells: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else call(bytes(c)) for c in cells], dtype=object)

    run = run.asNondeterministic() if once else run
    return lambda c: run(F.col(c).cast("binary") if isinstance(c, str) else c.cast("binary"))


def _all(kind: str, call, once: bool = False):
    """As _each, with call for the cells of a batch that aren't null, all at once."""

    @F.pandas_udf(kind)
    def run(cells: pd.Series) -> pd.Series:
        known = cells.notna()
        out = pd.Series([None] * len(cells), dtype=object)
        out[known.to_numpy()] = pd.Series(call([bytes(c) for c in cells[known]]), dtype=object).to_numpy()
        return out

    run = run.asNondeterministic() if once else run
    return lambda c: run(F.col(c).cast("binary") if isinstance(c, str) else c.cast("binary"))


def _lenient(call, strict: bool):
    def run(data):
        try:
            return call(data)
        except (block.BlockError, frames.FrameError):
            if strict:
                raise
            return None

    return run


def block_encode(c, acceleration: int = 1, level: int = 0, dictionary: bytes = b"") -> Column:
    """The cell as one compressed block."""
    return _all("binary", lambda cells: batch.encode_many(cells, acceleration, level, dictionary), once=True)(c)


def block_encode_into(c, room: int, acceleration: int = 1, level: int = 0) -> Column:
    """struct(block, consumed): as much of the cell as fits `room` bytes."""

    @F.pandas_udf("block binary, consumed long")
    def run(cells: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if x is None else block.encode_into(bytes(x), room, acceleration, level) for x in cells], columns=["block", "consumed"])

    return run(F.col(c).cast("binary") if isinstance(c, str) else c.cast("binary"))


def block_decode(c, most: int | None = None, dictionary: bytes = b"", strict: bool = False) -> Column:
    return _all("binary", lambda cells: batch.decode_many(cells, most, dictionary, None if strict else lambda e: None))(c)


def block_decode_partial(c, target: int, dictionary: bytes = b"", strict: bool = False) -> Column:
    """The first `target` bytes of the cell's block."""
    return _each("binary", _lenient(lambda d: block.decode(d, None, dictionary, target), strict))(c)


def block_error(c, most: int | None = None, dictionary: bytes = b"") -> Column:
    """What is wrong with the cell as a block, with the position; null if it decodes."""

    def run(data):
        try:
            block.decode(data, most, dictionary)
        except block.BlockError as e:
            return str(e)
        return None

    return _each("string", run)(c)


def frame_encode(c, options: frames.Options = frames.Options(), dictionary: bytes = b"") -> Column:
    """The cell as one frame."""
    return _all("binary", lambda cells: frames.encode_many(cells, options, dictionary), once=True)(c)


def frame_decode(c, dictionary: bytes = b"", skip_checksums: bool = False, pass_through: bool = False, ignore_garbage: bool = False, strict: bool = False) -> Column:
    """The bytes of all frames in the cell, one after another."""
    return _each("binary", _lenient(lambda d: frames.decode(d, dictionary, not skip_checksums, pass_through, ignore_garbage), strict))(c)


def frame_error(c, dictionary: bytes = b"") -> Column:
    """The code of the first error among the cell's frames; null if all decode and their checksums hold."""
    return _each("string", lambda d: frames.test(d, dictionary))(c)


def legacy_encode(c, level: int = 0) -> Column:
    return _all("binary", lambda cells: frames.legacy_many(cells, level), once=True)(c)


def container_encode(c, block_size: int = 64 << 10, acceleration: int = 1) -> Column:
    """The cell in the sized container; an empty cell, which it can't hold, gives null."""
    return _each("binary", lambda d: frames.sized_container(d, block_size, acceleration) if d else None)(c)


def container_decode(c, strict: bool = False) -> Column:
    return _each("binary", _lenient(frames.decode_sized_container, strict))(c)


def skippable_frame(c, number: int = 0) -> Column:
    """The cell as a skippable frame, with built-in functions only."""
    data = F.col(c).cast("binary") if isinstance(c, str) else c.cast("binary")
    size = F.hex(F.octet_length(data))
    size = F.lpad(size, 8, "0")
    little = F.concat(*[F.substring(size, k, 2) for k in (7, 5, 3, 1)])
    return F.concat(F.lit((frames.SKIPPABLE + number).to_bytes(4, "little")), F.unhex(little), data)


def xxh32(c, seed: int = 0) -> Column:
    return _each("long", lambda d: hashing.xxh32(d, seed))(c)


def xxh64(c, seed: int = 0) -> Column:
    """The 64 bits as a signed long; with seed 42 the built-in xxhash64 of a binary column, which runs in the JVM."""
    if seed == 42:
        return F.xxhash64(F.col(c).cast("binary") if isinstance(c, str) else c.cast("binary"))
    return _each("long", lambda d: hashing.signed(hashing.xxh64(d, seed)))(c)


def zero_runs(c, least: int = 8) -> Column:
    """array<struct<start, length>> of the cell's runs of zero bytes."""

    @F.pandas_udf("array<struct<start: long, length: long>>")
    def run(cells: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else [{"start": a, "length": n} for a, n in block.zero_runs(bytes(x), least)] for x in cells], dtype=object)

    return run(F.col(c).cast("binary") if isinstance(c, str) else c.cast("binary"))


class Sequences:
    """UDTF: the sequences of a compressed block, one row each."""

    def eval(self, data: bytes):
        if data is not None:
            for s in block.sequences(bytes(data)):
                yield s.seq_no, len(s.literals), s.literals, s.offset, s.match_len


class Frames:
    """UDTF: the frames of a file, one row each, from headers and block words only."""

    def eval(self, data: bytes):
        if data is not None:
            for n, f in enumerate(frames.frames(bytes(data), decode=False)):
                yield n, f.kind, f.start, f.end, f.label, f.checksum, f.content_size, f.dict_id, len(f.blocks)


class Blocks:
    """UDTF: the blocks of all frames of a file, one row each."""

    def eval(self, data: bytes):
        if data is not None:
            for n, f in enumerate(frames.frames(bytes(data), decode=False)):
                for k, (at, size, stored) in enumerate(f.blocks):
                    yield n, k, at, size, stored


UDTFS = {
    "block_sequences": (Sequences, "seq_no int, lit_len int, literals binary, offset int, match_len int"),
    "frame_list": (Frames, "frame_no int, kind string, start long, end long, label string, checksum string, content_size long, dict_id long, blocks int"),
    "frame_blocks": (Blocks, "frame_no int, block_no int, offset long, size long, stored boolean"),
}


def register(spark: SparkSession) -> None:
    """Names for SQL: block_encode, block_decode, frame_encode, frame_decode, frame_error, xxh32, xxh64 and the UDTFs."""

    def each(kind, call):
        def run(cells: pd.Series) -> pd.Series:
            return pd.Series([None if c is None else call(bytes(c)) for c in cells], dtype=object)

        return F.pandas_udf(run, kind)

    binary, text, long = T.BinaryType(), T.StringType(), T.LongType()
    for name, kind, call in (
        ("block_encode", binary, block.encode),
        ("block_decode", binary, _lenient(block.decode, False)),
        ("frame_encode", binary, frames.encode),
        ("frame_decode", binary, _lenient(frames.decode, False)),
        ("frame_error", text, frames.test),
        ("xxh32", long, hashing.xxh32),
        ("xxh64", long, lambda d: hashing.signed(hashing.xxh64(d))),
    ):
        spark.udf.register(name, each(kind, call))
    for name, (handler, schema) in UDTFS.items():
        spark.udtf.register(name, F.udtf(handler, returnType=schema))


_MOST32 = 0xFFFFFFFF
# Fixed values of the 32-bit hash.
_PRIMES32 = (2654435761, 2246822519, 3266489917, 668265263, 374761393)


def _with(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def _times(x: Column, k: int) -> Column:
    """x * k modulo 2**32, in halves that fit a long."""
    return _with(x, lambda v: (v * (k & 0xFFFF) + F.shiftleft((v * (k >> 16)).bitwiseAND(0xFFFF), 16)).bitwiseAND(_MOST32))


def _turned(x: Column, by: int) -> Column:
    return _with(x.bitwiseAND(_MOST32), lambda v: F.shiftleft(v, by).bitwiseAND(_MOST32).bitwiseOR(F.shiftright(v, 32 - by)))


def header_checksum(words: Column, last: Column, n: Column) -> Column:
    """The checksum byte of a header's n = 2, 6, 10 or 14 bytes, by built-in expressions: the second byte of their 32-bit hash.

    words are the little-endian longs of four bytes each, last the two bytes behind them.
    """
    p1, p2, p3, p4, p5 = _PRIMES32
    h = F.aggregate(words, (F.lit(p5) + n.cast("long")).bitwiseAND(_MOST32), lambda h, w: _times(_turned(h + _times(w, p3), 17), p4))
    h = F.aggregate(last, h, lambda h, w: _times(_turned(h + _times(w, p5), 11), p1))

    def folded(x: Column, by: int) -> Column:
        return _with(x, lambda v: v.bitwiseXOR(F.shiftright(v, by)))

    h = folded(_times(folded(_times(folded(h, 15), p2), 13), p3), 16)
    return F.shiftright(h, 8).bitwiseAND(0xFF).cast("int")


def header_fields(c) -> Column:
    """struct of a standard frame header's fields and `error`, by built-in functions on its first bytes.

    All checks are made that a decoder makes of a header: length, magic, version, reserved bits, block size, checksum. content_size is a
    decimal, as Spark has no unsigned 64-bit numbers.
    """
    data = F.col(c).cast("binary") if isinstance(c, str) else c.cast("binary")

    def at(first, n):
        """The little-endian number of n bytes from a place on, null behind the end."""
        place = first if isinstance(first, Column) else F.lit(first)
        number = F.conv(F.concat(*[F.hex(F.substring(data, place + 1 + k, F.lit(1))) for k in range(n - 1, -1, -1)]), 16, 10)
        return F.when(F.octet_length(data) >= place + n, number)

    flags, sizes = at(4, 1).cast("int"), at(5, 1).cast("int")
    has_size, has_dict = flags.bitwiseAND(8) != 0, flags.bitwiseAND(1) != 0
    block_id = F.shiftright(sizes, 4).bitwiseAND(7)
    n = 2 + F.when(has_size, 8).otherwise(0) + F.when(has_dict, 4).otherwise(0)
    told = at(4 + n, 1).cast("int")
    words = F.slice(F.array(*[F.coalesce(at(4 + k, 4).try_cast("long"), F.lit(0).cast("long")) for k in (0, 4, 8)]), F.lit(1), F.floor(n / 4).cast("int"))
    checksum = header_checksum(words, F.array(at(2 + n, 1).cast("long"), at(3 + n, 1).cast("long")), n)
    error = (
        F.when(F.octet_length(data) < 7, "truncated").when(at(0, 4).cast("long") != frames.MAGIC, "wrong_magic").when(F.shiftright(flags, 6) != 1, "version_wrong")
        .when((flags.bitwiseAND(2) != 0) | (sizes.bitwiseAND(0x8F) != 0), "reserved_flag_set").when(block_id < 4, "block_size_invalid")
        .when(F.octet_length(data) < 5 + n, "truncated").when(told != checksum, "header_checksum_invalid")
    )
    return F.struct(
        error.alias("error"), block_id.alias("block_id"), (flags.bitwiseAND(32) != 0).alias("independent"), (flags.bitwiseAND(16) != 0).alias("block_checksum"),
        (flags.bitwiseAND(4) != 0).alias("content_checksum"), F.when(has_size, at(6, 8).try_cast("decimal(20,0)")).alias("content_size"),
        F.when(has_dict, at(F.when(has_size, 14).otherwise(6), 4).try_cast("long")).alias("dict_id"),
    )


def canonical(c, bits: int = 32) -> Column:
    """A hash as the hexadecimal of its big-endian bytes; longs count as unsigned."""
    return F.lpad(F.lower(F.hex(F.col(c) if isinstance(c, str) else c)), bits // 4, "0")
