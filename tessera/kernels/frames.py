"""The frame container and its kin.

Standard frames have a header with flags, blocks with a size word (high bit: stored as it is), an end mark
and optional checksums. Besides them a file may hold skippable frames (a magic of 16 and a size) and legacy
frames (8 MB blocks, no header). Frames may follow one another. The sized container has the same magic as a
standard frame, then the number of blocks, the block size and all sizes, so a reader must be told of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import xxhash

from . import batch
from . import block as codec

# Fixed values of the format.
MAGIC = 0x184D2204
SKIPPABLE = 0x184D2A50
LEGACY = 0x184C2102
LEGACY_BLOCK = 8 << 20
BLOCK_SIZES = {4: 64 << 10, 5: 256 << 10, 6: 1 << 20, 7: 4 << 20}
LEAST_BLOCK, MOST_BLOCK = 32, 4 << 20
LEAST_LEVEL, LEAST_LEGACY_LEVEL = 2, 3  # below, frames are greedy
STORED = 0x80000000


class FrameError(ValueError):
    """A frame that breaks the format; `code` names how."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


@dataclass(frozen=True)
class Options:
    """How frames are written. The defaults are those of the command line: 4 MB independent blocks, a content checksum.

    block_size cuts blocks of any size from 32 bytes to 4 MB, beyond which it is clamped; the header then names the smallest id that
    holds it. Levels 0 and 1 are greedy. store keeps every block as it is.
    """

    block_id: int = 7
    independent: bool = True
    block_checksum: bool = False
    content_checksum: bool = True
    content_size: bool = False
    dict_id: int | None = None
    level: int = 0
    acceleration: int = 1
    favor_decode: bool = False
    store: bool = False
    block_size: int | None = None

    @property
    def cut(self) -> int:
        """Bytes in a block."""
        return min(max(self.block_size, LEAST_BLOCK), MOST_BLOCK) if self.block_size else BLOCK_SIZES[self.block_id]

    def fitted(self, n: int) -> "Options":
        """These options for n bytes: the id shrinks to the custom size, and to what the data need; a single block is independent."""
        most = fitting_id(self.cut) if self.block_size else self.block_id
        own = replace(self, block_id=fitting_id(n, most))
        return replace(own, independent=True) if n <= own.cut else own


@dataclass
class Frame:
    """One frame of a file: where it is, what its header says, its blocks (offset, stored size, is stored as it is), its bytes if decoded."""

    kind: str
    start: int
    end: int = 0
    block_id: int | None = None
    independent: bool | None = None
    block_checksum: bool = False
    content_checksum: bool = False
    content_size: int | None = None
    dict_id: int | None = None
    header_size: int = 0
    blocks: list[tuple[int, int, bool]] = field(default_factory=list)
    payload: bytes | None = None
    magic: int = MAGIC

    @property
    def label(self) -> str:
        """B, the block size's id, and I or D for independent or dependent blocks."""
        return f"B{self.block_id}{'I' if self.independent else 'D'}" if self.block_id else "-"

    @property
    def checksum(self) -> str:
        return "XXH32" if self.content_checksum else "-"


def fitting_id(n: int, most: int = 7) -> int:
    """The smallest block id that holds n bytes, up to the one asked for."""
    return next((k for k in range(4, most) if n <= BLOCK_SIZES[k]), most)


def header(options: Options, size: int | None) -> bytes:
    """Magic and descriptor."""
    if options.block_id not in BLOCK_SIZES:
        raise FrameError("block_size_invalid")
    flags = 0x40 | options.independent << 5 | options.block_checksum << 4 | (size is not None) << 3 | options.content_checksum << 2 | (options.dict_id is not None)
    body = bytes([flags, options.block_id << 4])
    body += size.to_bytes(8, "little") if size is not None else b""
    body += options.dict_id.to_bytes(4, "little") if options.dict_id is not None else b""
    return MAGIC.to_bytes(4, "little") + body + bytes([xxhash.xxh32_intdigest(body) >> 8 & 0xFF])


def _words(raw: bytes, packed: bytes, options: Options) -> bytes:
    """A block with its size word, and its checksum if there are any; stored as it is where packing makes it no smaller."""
    stored = len(packed) >= len(raw)
    packed = raw if stored else packed
    return (len(packed) | stored << 31).to_bytes(4, "little") + packed + (xxhash.xxh32_intdigest(packed).to_bytes(4, "little") if options.block_checksum else b"")


def _packed(raws: list[bytes], fresh: list[bool], options: Options, dictionary: bytes, before: bytes = b"") -> list[bytes]:
    """The packed blocks, each of which continues the one before unless it is fresh."""
    level = options.level if not 0 <= options.level < LEAST_LEVEL else 0
    if options.store:
        return raws
    if not options.favor_decode:
        return batch.encode_streams(raws, fresh, options.acceleration, level, dictionary, before)
    out, tail = [], before
    for raw, new in zip(raws, fresh):
        tail = b"" if new else tail
        out.append(codec.encode(raw, options.acceleration, level, (dictionary + tail)[-codec.HISTORY :], True))
        tail = (tail + raw)[-codec.HISTORY :]
    return out


def _cut(data: bytes, options: Options) -> list[bytes]:
    return [data[at : at + options.cut] for at in range(0, len(data), options.cut)]


def encode_blocks(data: bytes, options: Options, history: bytes = b"") -> bytes:
    """The block words of data; `history` is what precedes it in a linked frame, or a dictionary."""
    raws = _cut(data, options)
    known = (history, b"") if options.independent else (b"", history)
    return b"".join(_words(r, p, options) for r, p in zip(raws, _packed(raws, [options.independent] * len(raws), options, *known)))


def encode(data: bytes, options: Options = Options(), dictionary: bytes = b"") -> bytes:
    """One frame. The block size shrinks to what the data need, and a single block is independent."""
    return encode_many([data], options, dictionary)[0]


def encode_many(datas: list[bytes], options: Options = Options(), dictionary: bytes = b"") -> list[bytes]:
    """encode() of each, their blocks packed together."""
    if options.block_id not in BLOCK_SIZES:
        raise FrameError("block_size_invalid")
    own = [options.fitted(len(d)) for d in datas]
    cut = [_cut(d, o) for d, o in zip(datas, own)]
    raws = [r for c in cut for r in c]
    fresh = [o.independent or not k for c, o in zip(cut, own) for k in range(len(c))]
    packed = iter(_packed(raws, fresh, options, dictionary[-codec.HISTORY :]))
    return [header(o, len(d) if o.content_size else None) + b"".join(_words(r, next(packed), o) for r in c) + ending(d, o) for d, o, c in zip(datas, own, cut)]


def ending(data: bytes, options: Options) -> bytes:
    """End mark and content checksum."""
    return bytes(4) + (xxhash.xxh32_intdigest(data).to_bytes(4, "little") if options.content_checksum else b"")


def skippable(data: bytes, number: int = 0) -> bytes:
    if not 0 <= number <= 15:
        raise FrameError("skippable_number_invalid")
    return (SKIPPABLE + number).to_bytes(4, "little") + len(data).to_bytes(4, "little") + data


def legacy(data: bytes, level: int = 0) -> bytes:
    """A legacy frame: each 8 MB block's compressed size, then the block. Levels 0 to 2 are greedy."""
    return legacy_many([data], level)[0]


def legacy_many(datas: list[bytes], level: int = 0) -> list[bytes]:
    """legacy() of each, their blocks packed together."""
    level = level if not 0 <= level < LEAST_LEGACY_LEVEL else 0
    cut = [[d[at : at + LEGACY_BLOCK] for at in range(0, len(d), LEGACY_BLOCK)] for d in datas]
    packed = iter(batch.encode_many([r for c in cut for r in c], level=level))
    return [LEGACY.to_bytes(4, "little") + b"".join(len(p).to_bytes(4, "little") + p for p in (next(packed) for _ in c)) for c in cut]


def sized_container(data: bytes, block_size: int = 64 << 10, acceleration: int = 1) -> bytes:
    """The container of the parallel engines: number of blocks, block size, all sizes, all blocks."""
    if not data:
        raise FrameError("empty_input")
    blocks = batch.encode_many([data[at : at + block_size] for at in range(0, len(data), block_size)], acceleration)
    words = [MAGIC, len(blocks), block_size, *map(len, blocks)]
    return b"".join(w.to_bytes(4, "little") for w in words) + b"".join(blocks)


def read_sized_container(data: bytes) -> tuple[int, list[tuple[int, int]]]:
    """(block size, blocks as (offset, size)), offsets being running sums of sizes."""
    words = [int.from_bytes(data[k : k + 4], "little") for k in (0, 4, 8)]
    if len(data) < 12 or words[0] != MAGIC:
        raise FrameError("wrong_magic")
    at, found = 12 + 4 * words[1], []
    if at > len(data):
        raise FrameError("truncated")
    for k in range(words[1]):
        size = int.from_bytes(data[12 + 4 * k : 16 + 4 * k], "little")
        found.append((at, size))
        at += size
    if at > len(data):
        raise FrameError("truncated")
    return words[2], found


def decode_sized_container(data: bytes) -> bytes:
    size, blocks = read_sized_container(data)
    return b"".join(_block(data[at : at + n], size, b"") for at, n in blocks)


def _block(data: bytes, most: int, history: bytes) -> bytes:
    try:
        return codec.decode(data, most, history)
    except codec.BlockError as e:
        raise FrameError("decode_failed") from e


def _word(data: bytes, at: int) -> int:
    if at + 4 > len(data):
        raise FrameError("truncated")
    return int.from_bytes(data[at : at + 4], "little")


def _header(data, start: int) -> tuple[Frame, int]:
    """A standard frame's header, and where its blocks begin."""
    head = data[start : start + 19]
    if len(head) < 7:
        raise FrameError("truncated")
    flags, sizes = head[4], head[5]
    if flags >> 6 != 1:
        raise FrameError("version_wrong")
    if flags & 2 or sizes & 0x8F:
        raise FrameError("reserved_flag_set")
    frame = Frame("standard", start, block_id=sizes >> 4 & 7, independent=bool(flags & 32), block_checksum=bool(flags & 16), content_checksum=bool(flags & 4))
    if frame.block_id not in BLOCK_SIZES:
        raise FrameError("block_size_invalid")
    at = 6
    if flags & 8:
        frame.content_size, at = int.from_bytes(head[at : at + 8], "little"), at + 8
    if flags & 1:
        frame.dict_id, at = int.from_bytes(head[at : at + 4], "little"), at + 4
    if at >= len(head):
        raise FrameError("truncated")
    if xxhash.xxh32_intdigest(head[4:at]) >> 8 & 0xFF != head[at]:
        raise FrameError("header_checksum_invalid")
    frame.header_size = at + 1
    return frame, start + at + 1


def _standard(data, start: int, decode: bool, verify: bool, dictionary: bytes):
    """(frame, bytes of a block) for each block, bytes null unless they are decoded; then (frame, None), its end known."""
    frame, at = _header(data, start)
    most, whole, size = BLOCK_SIZES[frame.block_id], xxhash.xxh32(), 0
    dictionary = dictionary[-codec.HISTORY :]
    tail = dictionary
    while word := _word(data, at):
        stored, n, at = bool(word & STORED), word & ~STORED, at + 4
        if n > most:
            raise FrameError("block_too_large")
        if at + n > len(data):
            raise FrameError("truncated")
        frame.blocks.append((at, n, stored))
        raw = data[at : at + n] if decode else b""
        at += n
        if frame.block_checksum:
            if decode and verify and _word(data, at) != xxhash.xxh32_intdigest(raw):
                raise FrameError("block_checksum_invalid")
            at += 4
        if decode:
            raw = raw if stored else _block(raw, most, tail)
            size += len(raw)
            if verify and frame.content_checksum:
                whole.update(raw)
            if not frame.independent:
                tail = (tail + raw)[-codec.HISTORY :]
        yield frame, raw if decode else b""
    at += 4
    if frame.content_checksum:
        told, at = _word(data, at), at + 4
        if decode and verify and told != whole.intdigest():
            raise FrameError("content_checksum_invalid")
    if decode and frame.content_size is not None and frame.content_size != size:
        raise FrameError("content_size_wrong")
    frame.end = at
    yield frame, None


def _legacy(data, start: int, decode: bool):
    """As _standard; blocks until the end or a word that is a magic or no possible size."""
    frame, at = Frame("legacy", start, magic=LEGACY, header_size=4), start + 4
    while at < len(data):
        n = _word(data, at)
        if n > codec.compress_bound(LEGACY_BLOCK):
            break
        if at + 4 + n > len(data):
            raise FrameError("truncated")
        frame.blocks.append((at + 4, n, False))
        yield frame, _block(data[at + 4 : at + 4 + n], LEGACY_BLOCK, b"") if decode else b""
        at += 4 + n
    frame.end = at
    yield frame, None


def blocks(data, decode: bool = True, verify: bool = True, dictionary: bytes = b"") -> Iterator[tuple[Frame, bytes | None]]:
    """(frame, bytes) of each block of the frames of a file in order, with (frame, None) at each frame's end.

    data is bytes, or anything that has their length and slices, such as a View of a file; without `decode` only headers
    and block words are looked at. Holds a block, and the 64 KB before it. Something else at the start, or nothing but it, is
    a FrameError `unknown_format`; behind a whole frame it is `trailing_garbage`.
    """
    at = 0
    while at < len(data):
        if at + 4 > len(data):
            raise FrameError("trailing_garbage" if at else "unknown_format")
        magic = _word(data, at)
        if magic == MAGIC:
            found = _standard(data, at, decode, verify, dictionary)
        elif magic & 0xFFFFFFF0 == SKIPPABLE:
            end = at + 8 + _word(data, at + 4)
            if end > len(data):
                raise FrameError("truncated")
            found = [(Frame("skippable", at, end, header_size=8, magic=magic), None)]
        elif magic == LEGACY:
            found = _legacy(data, at, decode)
        else:
            raise FrameError("trailing_garbage" if at else "unknown_format")
        for frame, raw in found:
            yield frame, raw
        at = frame.end


def frames(data, decode: bool = True, verify: bool = True, dictionary: bytes = b"") -> Iterator[Frame]:
    """The frames of a file in order, as blocks() finds them; with `decode` each has its payload."""
    held = []
    for frame, raw in blocks(data, decode, verify, dictionary):
        if raw is not None:
            held.append(raw)
        else:
            frame.payload = b"".join(held) if decode else None
            held = []
            yield frame


class View:
    """A file's bytes by range reads: len() and slices, small ones from a piece that is read ahead."""

    def __init__(self, read, size: int, ahead: int = 64 << 10):
        self.read, self.size, self.ahead = read, size, ahead  # read(position, n)
        self.first, self.held = 0, b""

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> bytes:
        a, b, _ = part.indices(self.size)
        if b - a > self.ahead:
            return self.read(a, b - a)
        if a < self.first or b > self.first + len(self.held):
            self.first, self.held = a, self.read(a, min(self.ahead, self.size - a))
        return self.held[a - self.first : b - self.first]


class FrameWriter:
    """Writes one standard frame block by block: holds a block, and the 64 KB before it. Some of the data can be stored as they are."""

    def __init__(self, out, options: Options, size: int | None = None, dictionary: bytes = b""):
        most = fitting_id(options.cut) if options.block_size else options.block_id
        self.out, self.options, self.tail = out, replace(options, block_id=most), dictionary[-codec.HISTORY :]
        self.held, self.whole = b"", xxhash.xxh32()
        out.write(header(self.options, size))

    def add(self, data: bytes, store: bool | None = None) -> None:
        """Appends data; with `store` other than before, what is held ends as a block of its own and the next ones are stored, or packed."""
        if store is not None and store != self.options.store:
            self.flush()
            self.options = replace(self.options, store=store)
        self.held += data
        whole = len(self.held) // self.options.cut * self.options.cut
        if whole:
            self._blocks(self.held[:whole])
            self.held = self.held[whole:]

    def flush(self) -> None:
        """Writes what is held as a block, so that a reader has all data so far."""
        self._blocks(self.held)
        self.held = b""

    def _blocks(self, data: bytes) -> None:
        self.out.write(encode_blocks(data, self.options, self.tail))
        self.whole.update(data)
        if not self.options.independent:
            self.tail = (self.tail + data)[-codec.HISTORY :]

    def close(self) -> None:
        self.flush()
        self.out.write(bytes(4) + (self.whole.intdigest().to_bytes(4, "little") if self.options.content_checksum else b""))
        self.out.close()


def decode(data: bytes, dictionary: bytes = b"", verify: bool = True, pass_through: bool = False, ignore_garbage: bool = False) -> bytes:
    """The bytes of all frames; with pass_through a file of another format as it is, with ignore_garbage the frames before what is no frame."""
    out = []
    try:
        for f in frames(data, True, verify, dictionary):
            out.append(f.payload)
    except FrameError as e:
        if pass_through and e.code == "unknown_format":
            return data
        if not (ignore_garbage and e.code == "trailing_garbage"):
            raise
    return b"".join(out)


def test(data: bytes, dictionary: bytes = b"") -> str | None:
    """None if every frame decodes and its checksums hold, else the error's code."""
    try:
        for _ in frames(data, dictionary=dictionary):
            pass
    except FrameError as e:
        return e.code
    return None
