"""Media columns: AVI motion JPEG with lossless intra frames, and shots as timed clips.

A payload's bytes are 8-bit grey samples of 24 by 24 pixels a frame. Each frame is a lossless JPEG
(process 14, 8 bits, predictor 1) in an AVI file with a RIFF index. Its Huffman table gives category k a
code of 9 - k bits (at least 1 for k = 8, 9 for k = 0), so code and extra bits of every difference make 9
bits: any decoder can read the frame, and arrays of samples are coded and decoded at once. Lossless grey frames of
other writers, of any size, table and predictor, are decoded sample by sample.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, small_batches, text_of

SIDE = 24
FRAME = SIDE * SIDE
FPS = 25
CODED = FRAME * 9 // 8
#: Frames that are coded or decoded at once.
RUN = 4096
#: Histogram bins of shots.
BINS = 32

#: Marker segments in front of a frame's coded data.
JPEG_HEAD = (
    b"\xff\xd8"
    + b"\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, SIDE, SIDE, 1, 1, 0x11, 0)
    + b"\xff\xc4" + struct.pack(">HB", 28, 0) + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))
    + b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 1, 0, 0)
)
JPEG_END = b"\xff\xd9"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """9-bit word of each difference + 255, and the difference of each word."""
    words, back = np.zeros(511, np.uint16), np.zeros(512, np.int16)
    for d in range(-255, 256):
        k = abs(d).bit_length()
        prefix = (1 << (9 - k)) - 2 if k < 9 else 0
        word = (prefix << k | (d if d > 0 else d + (1 << k) - 1)) & 0x1FF
        words[d + 255], back[word] = word, d
    return words, back


WORD_OF, DIFF_OF = _tables()


def code_frames(samples: np.ndarray) -> bytes:
    """Coded data, 648 bytes a frame and not yet stuffed, of frames (n, SIDE, SIDE)."""
    return b"".join(_code(samples[at : at + RUN]) for at in range(0, len(samples), RUN))


def _code(samples: np.ndarray) -> bytes:
    x = samples.astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    d += 255
    c = WORD_OF[d.reshape(-1, 8)]
    out = np.empty((len(c), 9), np.uint8)
    out[:, 0] = c[:, 0] >> 1
    for i in range(1, 8):
        out[:, i] = (c[:, i - 1] << (8 - i)) & 0xFF | c[:, i] >> (i + 1)
    out[:, 8] = c[:, 7] & 0xFF
    return out.tobytes()


def decode_frames(coded: bytes) -> np.ndarray:
    """The frames of code_frames."""
    b = np.frombuffer(coded, np.uint8).reshape(-1, 9).astype(np.uint16)
    c = np.empty((len(b), 8), np.uint16)
    for i in range(8):
        c[:, i] = (b[:, i] << (i + 1)) & 0x1FF | b[:, i + 1] >> (7 - i)
    x = DIFF_OF[c].reshape(-1, SIDE, SIDE).astype(np.uint8)  # sums of differences are samples, modulo 256
    x[:, 0, 0] += 128
    x[:, :, 0] = np.cumsum(x[:, :, 0], axis=1, dtype=np.uint8)
    return np.cumsum(x, axis=2, dtype=np.uint8)


@dataclass(frozen=True)
class Coded:
    """A frame's size, predictor and Huffman table (counts by length, then symbols), and its coded data without stuffing."""

    height: int
    width: int
    predictor: int
    table: bytes
    data: bytes

    @property
    def plain(self) -> bool:
        """Whether it is coded as code_frames does."""
        return (self.height, self.width, self.predictor, self.table) == (SIDE, SIDE, 1, OWN_TABLE)


OWN_TABLE = bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))
#: Fixed values of the format: markers without a segment, those of frames other than lossless ones, and those of tables and restarts.
ALONE = {0x01, *range(0xD0, 0xD8)}
OTHER_FRAMES = {0xC0, 0xC1, 0xC2, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF}
SOF3, DHT, SOS, DRI, EOI = 0xC3, 0xC4, 0xDA, 0xDD, 0xD9


def read_frame(jpeg: bytes) -> Coded:
    """A frame by a walk of its markers. What isn't lossless, grey, of 8 bits and one scan is named in the error."""
    if jpeg.startswith(JPEG_HEAD) and jpeg.endswith(JPEG_END) and len(jpeg) < 1 << 16:  # the same walk's result for frames of this module
        data = jpeg[len(JPEG_HEAD) : -2].replace(b"\xff\x00", b"\xff")
        if len(data) == CODED:
            return Coded(SIDE, SIDE, 1, OWN_TABLE, data)
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("no JPEG frame")
    at, size, tables = 2, None, {}
    while True:
        if at + 4 > len(jpeg) or jpeg[at] != 0xFF:
            raise ValueError("a JPEG frame without a scan")
        mark = jpeg[at + 1]
        if mark == 0xFF or mark in ALONE:
            at += 1 if mark == 0xFF else 2
            continue
        n = struct.unpack_from(">H", jpeg, at + 2)[0]
        body, at = jpeg[at + 4 : at + 2 + n], at + 2 + n
        if mark in OTHER_FRAMES:
            raise ValueError(f"a JPEG frame of another process (0xFF{mark:02X}), not the lossless one")
        if mark == EOI:
            raise ValueError("a JPEG frame without a scan")
        if mark == SOF3:
            bits, height, width, parts = struct.unpack_from(">BHHB", body)
            if bits != 8 or parts != 1:
                raise ValueError(f"a JPEG frame of {parts} components of {bits} bits")
            if not height or not width:
                raise ValueError("a JPEG frame without its size")
            size = height, width
        elif mark == DHT:
            k = 0
            while k + 17 <= len(body):
                total = sum(body[k + 1 : k + 17])
                tables[body[k] & 15] = body[k + 1 : k + 17 + total]
                k += 17 + total
        elif mark == DRI and any(body[:2]):
            raise ValueError("a JPEG frame with restart intervals")
        elif mark == SOS:
            parts, _, table, predictor, _, shift = struct.unpack_from(">6B", body)
            if size is None or parts != 1 or table >> 4 not in tables or not 1 <= predictor <= 7:
                raise ValueError("a JPEG scan that doesn't fit its frame")
            if shift & 15:
                raise ValueError("a JPEG scan with a point transform")
            break
    end = jpeg.rfind(JPEG_END)
    if end < at:
        raise ValueError("a JPEG frame without its end")
    return Coded(*size, predictor, tables[table >> 4], jpeg[at:end].replace(b"\xff\x00", b"\xff"))


def decode_frame(frame: Coded) -> np.ndarray:
    """Samples (height, width) of any frame that read_frame accepts, difference by difference."""
    lookup, code, symbols = {}, 0, iter(frame.table[16:])
    for length, count in enumerate(frame.table[:16], 1):
        for _ in range(count):
            lookup[length, code] = next(symbols)
            code += 1
        code <<= 1
    bits, have, at = 0, 0, 0
    data = frame.data

    def take(n: int) -> int:
        nonlocal bits, have, at
        while have < n:
            if at >= len(data):
                raise ValueError("a JPEG scan shorter than its frame")
            bits, have, at = bits << 8 | data[at], have + 8, at + 1
        have -= n
        found = bits >> have
        bits &= (1 << have) - 1
        return found

    h, w, kind = frame.height, frame.width, frame.predictor
    out = np.zeros((h, w), np.uint8)
    above = [0] * w
    for y in range(h):
        row: list[int] = []
        for x in range(w):
            code, length = take(1), 1
            while (length, code) not in lookup:
                if length == 16:
                    raise ValueError("a JPEG code outside its table")
                code, length = code << 1 | take(1), length + 1
            k = lookup[length, code]
            if k > 16:
                raise ValueError("a JPEG code outside its table")
            more = take(k) if k and k < 16 else 32768 if k else 0
            d = more if not k or k == 16 or more >> (k - 1) else more - (1 << k) + 1
            a = row[-1] if x else 0
            b, c = above[x], above[x - 1] if x else 0
            if not y:
                guess = a if x else 128
            elif not x:
                guess = b
            else:
                guess = (a, b, c, a + b - c, a + ((b - c) >> 1), b + ((a - c) >> 1), (a + b) >> 1)[kind - 1]
            row.append((guess + d) & 0xFF)
        out[y], above = row, row
    return out


def chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def avi(payload_size: int, coded: bytes, n: int) -> bytes:
    """An AVI file of n frames of coded data; the payload's unpadded size is kept in a chunk `plen`."""
    movi, index, at = [], [], 4
    for k in range(n):
        jpeg = JPEG_HEAD + coded[k * CODED : (k + 1) * CODED].replace(b"\xff", b"\xff\x00") + JPEG_END
        movi.append(chunk(b"00dc", jpeg))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(jpeg)))
        at += len(movi[-1])
    most = max(map(len, movi))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, n, 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    strl = chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + strl + chunk(b"plen", struct.pack("<Q", payload_size)))
    return chunk(b"RIFF", b"AVI " + hdrl + chunk(b"LIST", b"movi" + b"".join(movi)) + chunk(b"idx1", b"".join(index)))


def _chunks(data: bytes, at: int, end: int):
    while at + 8 <= end:
        name, size = struct.unpack_from("<4sI", data, at)
        if at + 8 + size > end:
            raise ValueError(f"the chunk {name!r} runs past its parent's end")
        yield name, at + 8, size
        at += 8 + size + (size & 1)


def parse_avi(data: bytes) -> tuple[int, list[bytes]]:
    """(payload size or -1, JPEG frames) by the RIFF tree and its index; frames in file order where it has none."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, index, size = None, None, -1
    for name, at, n in _chunks(data, 12, 8 + struct.unpack_from("<I", data, 4)[0]):
        kind = data[at : at + 4] if name == b"LIST" else b""
        if kind == b"movi":
            movi = at, n
        elif kind == b"hdrl":
            size = next((struct.unpack_from("<Q", data, a)[0] for own, a, _ in _chunks(data, at + 4, at + n) if own == b"plen"), -1)
        elif name == b"idx1":
            index = at, n
    if movi is None:
        raise ValueError("an AVI file without frames")
    if index is None:
        return size, [data[a : a + n] for name, a, n in _chunks(data, movi[0] + 4, sum(movi)) if name[2:] in (b"dc", b"db")]
    frames = []
    for name, _, at, n in struct.iter_unpack("<4sIII", data[index[0] : sum(index)]):
        at += movi[0]
        if data[at : at + 4] != name or at + 8 + n > sum(movi):
            raise ValueError("an index entry that points at no frame")
        frames.append(data[at + 8 : at + 8 + n])
    return size, frames


def histograms(samples: np.ndarray) -> np.ndarray:
    """Counts (frames, BINS) of samples by level."""
    n = len(samples)
    level = samples.reshape(n, -1) >> (8 - BINS.bit_length() + 1)
    return np.bincount((level.astype(np.int32) + np.arange(n, dtype=np.int32)[:, None] * BINS).reshape(-1), minlength=n * BINS).reshape(n, BINS).astype(np.int32)


def shots(counts: np.ndarray, window: int = 8, factor: int = 2, floor: int = FRAME // 8) -> list[int]:
    """First frames of shots by the frames' histograms: 0, and each whose histogram differs from the one before adaptively much.

    A difference (sum of absolute bin differences) is a cut if it is more than `factor` times the mean of up
    to `window` differences to either side of it, plus `floor`. In whole numbers, so any machine agrees.
    """
    if len(counts) < 2:
        return [0]
    d = np.abs(np.diff(counts, axis=0)).sum(axis=1).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(d)])
    at = np.arange(len(d))
    lo, hi = np.maximum(0, at - window), np.minimum(len(d), at + window + 1)
    around, near = total[hi] - total[lo] - d, hi - lo - 1
    cut = d * np.maximum(near, 1) > factor * around + floor * np.maximum(near, 1)
    return [0, *(np.flatnonzero(cut) + 1).tolist()]


def to_media(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and media, an AVI file that holds each whole text's UTF-8 bytes, padded with 255 to whole frames.

    Null text counts as empty: one frame of padding. Equal texts have equal files. Ids may be null or repeat;
    other columns are ignored; no rows give none. One pass without a shuffle; a task codes about 2 MB of frames at a time.
    """

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("media", pa.binary())])

        def rows():
            for batch in batches:
                docs, texts = batch.column(0).to_pylist(), batch.column(1)
                at = 0
                while at < len(docs):
                    held, size = [], 0
                    while at + len(held) < len(docs) and size < 2 << 20:
                        raw = texts[at + len(held)].as_py().encode("utf-8")
                        n = max(1, -(-len(raw) // FRAME))
                        held.append((len(raw), n, raw.ljust(n * FRAME, b"\xff")))
                        size += n * FRAME
                    coded = code_frames(np.frombuffer(b"".join(h[2] for h in held), np.uint8).reshape(-1, SIDE, SIDE))
                    first = 0
                    for k, (size, n, _) in enumerate(held):
                        yield docs[at + k], avi(size, coded[first * CODED : (first + n) * CODED], n)
                        first += n
                    at += len(held)

        yield from in_batches(rows(), schema, weigh=lambda r: len(r[1]))

    small_batches(df.sparkSession)
    return df.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text")).mapInArrow(run, "doc_id long, media binary")


READ = "doc_id long, media_bytes long, media_sha256 string, n_bytes long, payload binary, shots array<int>, frames int, error string"


def _runs(files, most: int):
    """Lists of files (any tuple that ends with its frames) with about `most` frames together."""
    held, n = [], 0
    for f in files:
        held.append(f)
        n += len(f[-1])
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


def decode_all(files: list[list[Coded]]) -> list[tuple[bytes, np.ndarray]]:
    """(samples, histograms) of each file's frames. Frames of this module's kind are decoded RUN at a time, whichever files they are of."""
    out = [([], []) for _ in files]
    owner = [k for k, f in enumerate(files) for _ in f]
    frames = [x for f in files for x in f]
    at = 0
    while at < len(frames):
        to = at + 1
        if frames[at].plain:
            while to < len(frames) and to - at < RUN and frames[to].plain:
                to += 1
            samples = decode_frames(b"".join(f.data for f in frames[at:to]))
        else:
            samples = decode_frame(frames[at])[None]
        counts = histograms(samples)
        first = at
        while first < to:
            last = first
            while last < to and owner[last] == owner[first]:
                last += 1
            out[owner[first]][0].append(samples[first - at : last - at].tobytes())
            out[owner[first]][1].append(counts[first - at : last - at])
            first = last
        at = to
    return [(b"".join(s), np.concatenate(c)) for s, c in out]


def read_media(df: DataFrame) -> DataFrame:
    """Frames of the files in `media` decoded: doc_id, media_bytes, media_sha256 (of the file), n_bytes, payload (with padding), shots, frames, error.

    shots are the first frames of shots. A null or damaged file, and a frame that isn't lossless and grey, give null values and an
    error that says so. Equal files give equal rows; ids may be null or repeat; no rows give none. The columns of df other than
    doc_id and media don't matter. A task holds files of RUN frames together, or one file, and what they decode to.
    """
    from hashlib import sha256

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("shots", pa.list_(pa.int32())), ("frames", pa.int32()), ("error", pa.string())])

        def files(batch):
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = data.as_py() or b""
                file = len(data), sha256(data).hexdigest()
                try:
                    n, frames = parse_avi(data)
                    if not frames:
                        raise ValueError("no frame")
                    yield doc, *file, n, None, [read_frame(f) for f in frames]
                except (ValueError, struct.error) as e:
                    yield doc, *file, None, str(e), []

        def decoded(held):
            try:
                return decode_all([f[-1] for f in held])
            except ValueError:  # one by one, to tell which
                found = []
                for f in held:
                    try:
                        found += decode_all([f[-1]])
                    except ValueError as e:
                        found.append(str(e))
                return found

        def rows():
            for batch in batches:
                for held in _runs(files(batch), RUN):
                    good = [f for f in held if f[-1]]
                    for doc, size, digest, *_, error, frames in held:
                        if not frames:
                            yield doc, size, digest, None, None, None, None, error
                    for (doc, size, digest, n, _, frames), own in zip(good, decoded(good)):
                        if isinstance(own, str):
                            yield doc, size, digest, None, None, None, None, own
                        else:
                            yield doc, size, digest, n, own[0], shots(own[1]), len(frames), None

        yield from in_batches(rows(), schema, weigh=lambda r: len(r[4] or b"") + 200)

    return df.select("doc_id", "media").mapInArrow(run, READ)


def timed(shots="shots", frames="frames"):
    """A column: the shots as an array of clips (first_frame, frames, start_s, end_s)."""
    ends = F.concat(F.slice(shots, F.lit(2), F.greatest(F.size(shots) - 1, F.lit(0))), F.array(frames))
    pairs = F.arrays_zip(F.col(shots).alias("first"), ends.alias("last"))
    return F.transform(pairs, lambda x: F.struct(x["first"].alias("first_frame"), (x["last"] - x["first"]).alias("frames"), (x["first"] / FPS).alias("start_s"), (x["last"] / FPS).alias("end_s")))


def clips(read: DataFrame) -> DataFrame:
    """A row for each shot of read_media's rows: doc_id, clip, first_frame, frames, start_s, end_s. Rows with an error have none."""
    each = read.where("error is null").select("doc_id", F.posexplode(timed()).alias("clip", "own"))
    return each.select("doc_id", "clip", "own.first_frame", "own.frames", "own.start_s", "own.end_s")
