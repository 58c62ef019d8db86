"""The block codec: bytes <-> sequences of literals and back-references.

A compressed block is a row of sequences: a token whose high four bits count literals and low four the match
length less 4 (15 goes on in bytes up to the first below 255), the literals, and a 16-bit little-endian
distance. The last sequence has literals only; the last 5 bytes are literals, and no match starts in the
last 12. Everything here is plain functions on bytes, without Spark.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Fixed values of the format.
LEAST_MATCH = 4
LAST_LITERALS = 5
MATCH_LIMIT = 12
WINDOW = 65535
HISTORY = 65536
MOST_INPUT = 0x7E000000
MOST_ACCELERATION = 65537
MOST_LEVEL = 12
VERSION = (1, 10, 0)

#: Compressed bytes between which a block is decoded by arrays, and the most bytes, history among them, that are laid out so.
ARRAYS_FROM, ARRAYS_TO, ARRAYS_MOST = 200, 1 << 20, 4 << 20
#: Steps by which matches are made longer for all positions at once; longer ones go on by themselves.
STEPS = 24
#: Length from which on a repetition of a few bytes is taken without a further search.
LONG_RUN = 64


class BlockError(ValueError):
    """A block that breaks the format; `position` is where in the compressed bytes."""

    def __init__(self, reason: str, position: int):
        super().__init__(f"{reason} at byte {position}")
        self.reason, self.position = reason, position


@dataclass(frozen=True)
class Sequence:
    """Literals and the match behind them; offset and match_len are None in the last one."""

    seq_no: int
    literals: bytes
    offset: int | None
    match_len: int | None


def compress_bound(n: int) -> int:
    """The most bytes that n bytes compress to; 0 if n is too many."""
    return 0 if n < 0 or n > MOST_INPUT else n + n // 255 + 16


def _length(data, at: int, end: int, n: int) -> tuple[int, int]:
    if n < 15:
        return n, at
    while True:
        if at >= end:
            raise BlockError("a length runs past the end", at)
        more = data[at]
        n, at = n + more, at + 1
        if more < 255:
            return n, at


def sequences(data: bytes) -> list[Sequence]:
    """The sequences of a compressed block, offsets unchecked against history."""
    found, at, end = [], 0, len(data)
    if not end:
        raise BlockError("an empty block", 0)
    while True:
        if at >= end:
            raise BlockError("no last literals", at)
        token = data[at]
        n, at = _length(data, at + 1, end, token >> 4)
        if at + n > end:
            raise BlockError("literals run past the end", at)
        literals, at = data[at : at + n], at + n
        if at == end:
            found.append(Sequence(len(found), literals, None, None))
            return found
        if at + 2 > end:
            raise BlockError("a truncated offset", at)
        offset = data[at] | data[at + 1] << 8
        if not offset:
            raise BlockError("an offset of 0", at)
        length, at = _length(data, at + 2, end, token & 15)
        found.append(Sequence(len(found), literals, offset, length + LEAST_MATCH))


def decode(data: bytes, most: int | None = None, history: bytes = b"", target: int | None = None) -> bytes:
    """The bytes of a block. `most` bounds their number, `history` precedes them, `target` stops early.

    With a target the result is the first `target` bytes, and what lies behind them isn't looked at.
    """
    at, end = 0, len(data)
    if not end:
        raise BlockError("an empty block", 0)
    if target is None and ARRAYS_FROM <= end <= ARRAYS_TO:
        whole = _decode_arrays(data, most if most is not None else MOST_INPUT, history[-HISTORY:])
        if whole is not None:
            return whole
    out = bytearray(history[-HISTORY:])
    base = len(out)
    cap = base + (most if most is not None else MOST_INPUT)
    stop = base + target if target is not None else None
    while True:
        if stop is not None and len(out) >= stop:
            return bytes(out[base:stop])
        if at >= end:
            raise BlockError("no last literals", at)
        token = data[at]
        n = token >> 4
        at += 1
        if n == 15:
            n, at = _length(data, at, end, n)
        if at + n > end:
            if stop is not None and len(out) + end - at >= stop:
                return bytes((out + data[at:])[base:stop])
            raise BlockError("literals run past the end", at)
        out += data[at : at + n]
        at += n
        if len(out) > cap:
            raise BlockError("more bytes than allowed", at)
        if at == end:
            return bytes(out[base:stop])
        if at + 2 > end:
            if stop is not None and len(out) >= stop:
                return bytes(out[base:stop])
            raise BlockError("a truncated offset", at)
        offset = data[at] | data[at + 1] << 8
        if not offset or offset > len(out):
            raise BlockError("an offset outside the window", at)
        at += 2
        n = token & 15
        if n == 15:
            n, at = _length(data, at, end, n)
        n += LEAST_MATCH
        if len(out) + n > cap:
            raise BlockError("more bytes than allowed", at)
        start = len(out) - offset
        if n <= offset:
            out += out[start : start + n]
        else:  # the match overlaps itself: its period repeats
            period = bytes(out[start:])
            out += (period * (n // offset + 1))[:n]


def _decode_arrays(data: bytes, most: int, history: bytes) -> bytes | None:
    """decode() of a whole block by arrays; None if it is damaged, or too large to be laid out, which the caller finds out step by step.

    Every position is read as if a sequence began there, so that the sequences that are there are a chain to follow. Then
    literals are put in their places at once, and each byte of a match is looked up from byte to byte, doubling the
    steps, until it is a literal's or the history's.
    """
    n = len(data)
    raw = np.frombuffer(data, np.uint8)
    d = np.zeros(n + 3, np.int32)
    d[:n] = raw
    here = np.arange(n + 3, dtype=np.int32)
    # Where a length that goes on from a position ends, and what it adds.
    last = np.minimum.accumulate(np.where(d != 255, here, n + 2)[::-1])[::-1]
    more = 255 * (last - here) + d[last]
    token, first = d[:n], here[1 : n + 1]
    long = token >= 240
    n_literal = np.where(long, 15 + more[first], token >> 4)
    literal = np.where(long, last[first] + 1, first)
    stop = np.minimum(literal.astype(np.int64) + n_literal, n + 1).astype(np.int32)
    behind = np.minimum(stop + 2, n + 2)
    long = (token & 15) == 15
    n_match = LEAST_MATCH + np.where(long, 15 + more[behind], token & 15)
    following = memoryview(np.ascontiguousarray(np.where(long, last[behind] + 1, behind), np.int32))
    at, places = 0, []
    while at < n:
        places.append(at)
        at = following[at]
    chain = np.array(places, np.int32)
    stops, n_literal, literal, n_match = stop[chain].astype(np.int64), n_literal[chain].astype(np.int64), literal[chain].astype(np.int64), n_match[chain].astype(np.int64)
    if stops[-1] != n or (stops[:-1] + 2 > n).any():
        return None
    n_match[-1] = 0
    base = len(history)
    ends = base + np.cumsum(n_literal + n_match)
    total = int(ends[-1])
    if total - base > most or total > ARRAYS_MOST:
        return None
    starts = ends - n_match  # of matches
    by = (d[stops[:-1]] | d[stops[:-1] + 1] << 8).astype(np.int64)
    if (by == 0).any() or (by > starts[:-1]).any():
        return None
    out = np.empty(total, np.uint8)
    out[:base] = np.frombuffer(history, np.uint8)
    out[_ranges(starts - n_literal, n_literal)] = raw[_ranges(literal, n_literal)]
    copied = _ranges(starts[:-1], n_match[:-1]).astype(np.int32)
    if len(copied):
        source = copied - np.repeat(by, n_match[:-1]).astype(np.int32)
        pointer = np.arange(total, dtype=np.int32)
        while True:
            pointer[copied] = source
            further = pointer[source]
            if (further == source).all():
                break
            source = further
        out[copied] = out[source]
    return out[base:].tobytes()


def _extend(buf: bytes, a: int, b: int, end: int) -> int:
    """How many bytes from a equal those from b, b < end."""
    n, step = 0, 16
    while b + n < end:
        width = min(step, end - b - n)
        x, y = buf[a + n : a + n + width], buf[b + n : b + n + width]
        if x == y:
            n += width
            step = min(4096, step * 2)
        elif width <= 16:
            diff = int.from_bytes(x, "little") ^ int.from_bytes(y, "little")
            return n + ((diff & -diff).bit_length() - 1) // 8
        else:
            step = 16
    return n


def _emit(out: bytearray, literals: bytes, offset: int = 0, length: int = 0) -> None:
    n, m = len(literals), length - LEAST_MATCH
    out.append(min(n, 15) << 4 | (min(m, 15) if offset else 0))
    if n >= 15:
        out += b"\xff" * ((n - 15) // 255)
        out.append((n - 15) % 255)
    out += literals
    if offset:
        out += offset.to_bytes(2, "little")
        if m >= 15:
            out += b"\xff" * ((m - 15) // 255)
            out.append((m - 15) % 255)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for lengths[0] numbers, then the same of starts[1], ..."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _write(buf: bytes, base: int, matches) -> bytes:
    """A block from matches (position, offset, length) in ascending order, laid out as arrays."""
    if not len(matches):
        out = bytearray()
        _emit(out, buf[base:])
        return bytes(out)
    at, offset, length = np.array(matches, np.int64).T
    anchor = np.concatenate([[base], (at + length)[:-1]])
    n, m = at - anchor, length - LEAST_MATCH
    n_more, m_more = np.where(n >= 15, (n - 15) // 255 + 1, 0), np.where(m >= 15, (m - 15) // 255 + 1, 0)
    size = 3 + n + n_more + m_more
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    out[start] = np.minimum(n, 15) << 4 | np.minimum(m, 15)
    literal = start + 1 + n_more
    for value, more, first in ((n, n_more, start + 1), (m, m_more, literal + n + 2)):
        some = more > 0
        if some.any():
            out[_ranges(first[some], more[some])] = 255
            out[(first + more - 1)[some]] = (value[some] - 15) % 255
    out[_ranges(literal, n)] = np.frombuffer(buf, np.uint8)[_ranges(anchor, n)]
    out[literal + n], out[literal + n + 1] = offset & 255, offset >> 8
    rest = bytearray()
    _emit(rest, buf[int(at[-1] + length[-1]) :])
    return out.tobytes() + bytes(rest)


def _previous(buf: bytes, width: int) -> np.ndarray:
    """For each position the distance to the last place of its `width` bytes, 0 if there is none within the window; the last positions have 0.

    All positions are sorted at once by their bytes, two at a time from the last to the first; neighbours that agree are
    one another's last places.
    """
    n = len(buf) - width + 1
    data = np.frombuffer(buf, np.uint8)
    keys = [data[k : k + n].astype(np.uint16) | (data[k + 1 : k + 1 + n].astype(np.uint16) << 8 if k + 1 < width else 0) for k in range(0, width, 2)]
    order = np.argsort(keys[0], kind="stable")  # 16-bit keys: radix sorts
    for key in keys[1:]:
        order = order[np.argsort(key[order], kind="stable")]
    same = np.ones(n - 1, bool)
    for key in keys:
        own = key[order]
        same &= own[1:] == own[:-1]
    distance = np.zeros(len(buf), np.int32)
    distance[order[1:][same]] = (order[1:] - order[:-1])[same]
    distance[distance > WINDOW] = 0
    return distance


def _fast(buf: bytes, base: int, acceleration: int) -> np.ndarray:
    """Greedy parse over the last place of each position's four bytes.

    Neighbours with the same distance are one match, so lengths come with the distances; matches are made longer where the bytes
    behind them agree too, all at once for some steps. What is left is a chain to follow from match to match. Acceleration looks at every so
    manieth position.
    """
    limit, end = len(buf) - MATCH_LIMIT, len(buf) - LAST_LITERALS
    data = np.frombuffer(buf, np.uint8)
    distance = _previous(buf, 4)[: len(buf) - 2]
    places = np.arange(len(buf) - 3, dtype=np.int32)
    stops = np.where(distance[1:] != distance[:-1], places, np.int32(len(places)))
    stops = np.minimum.accumulate(stops[::-1])[::-1]
    starts = (distance[:-1] > 0) & (places >= base) & (places <= limit)
    if acceleration > 1:
        starts &= (places - base) % acceleration == 0
    following = np.minimum.accumulate(np.where(starts, places, np.int32(len(buf)))[::-1])[::-1]
    behind = np.minimum(stops + 4, end).astype(np.int32)  # where each match ends
    some = np.flatnonzero(starts).astype(np.int32)
    for _ in range(STEPS):
        stop = behind[some]
        goes_on = (stop < end) & (data[stop] == data[stop - distance[some]])
        some = some[goes_on]
        if not len(some):
            break
        behind[some] += 1
    longer = set(some.tolist())
    following, ends, found, at = memoryview(np.ascontiguousarray(following)), memoryview(behind), [], base
    while at <= limit:
        at = following[at]
        if at > limit:
            break
        found.append(at)
        if at in longer:
            stop = ends[at]
            behind[at] = stop + _extend(buf, stop - int(distance[at]), stop, end)
        at = ends[at]
    at = np.array(found, np.int64)
    return np.stack([at, distance[at], behind[at] - at], axis=1)


def _mid(buf: bytes, base: int) -> list[tuple[int, int, int]]:
    """Parse over two distances a position: to the last place of its seven bytes and of its four.

    The seven bytes come first; a match by four gives way to a longer one by seven that starts a byte later. Matches
    also grow backwards into literals.
    """
    limit, end = len(buf) - MATCH_LIMIT, len(buf) - LAST_LITERALS
    short = _previous(buf, 4)
    far = _previous(buf, 7)
    near = np.flatnonzero((short[: limit + 1] > 0) & (np.arange(limit + 1) >= base))
    short, far, found, at, anchor, k = memoryview(short), memoryview(far), [], base, base, 0
    near = near.tolist()
    while k < len(near):
        at = near[k]
        k += 1
        if at < anchor:
            continue
        by = far[at] or short[at]
        n = _extend(buf, at - by, at, end)
        if not far[at] and at < limit and far[at + 1]:
            more = _extend(buf, at + 1 - far[at + 1], at + 1, end)
            if more > n:
                at, by, n = at + 1, far[at + 1], more
        while at > anchor and at > by and buf[at - 1] == buf[at - 1 - by]:
            at, n = at - 1, n + 1
        found.append((at, by, n))
        anchor = at + n
    return found


class _Chains:
    """Positions of each 4 bytes, newest last, for the searching parsers."""

    def __init__(self, buf: bytes, base: int, favor_decode: bool = False):
        self.buf, self.at, self.places, self.favor_decode = buf, 0, {}, favor_decode
        self.fill(base)

    def fill(self, to: int) -> None:
        buf, places = self.buf, self.places
        for i in range(self.at, min(to, len(buf) - 3)):
            places.setdefault(buf[i : i + 4], []).append(i)
        self.at = max(self.at, to)

    def longest(self, at: int, end: int, tries: int, longer_than: int = 3) -> tuple[int, int]:
        """(length, offset) of the longest match among the newest `tries` places, (0, 0) if none is long enough.

        Where decoding speed is favoured, offsets below 8 don't count and lengths of 19 to 36 are cut to 18, which
        decoders copy in one step.
        """
        n, offset = self._longest(at, end, tries, longer_than)
        if self.favor_decode and 19 <= n <= 36:
            return (18, offset) if longer_than < 18 else (0, 0)
        return n, offset

    def _longest(self, at: int, end: int, tries: int, longer_than: int) -> tuple[int, int]:
        self.fill(at)
        buf, best, offset = self.buf, longer_than, 0
        inside = self._run(at, end)
        if inside and not self.favor_decode and inside[0] > best:
            best, offset = inside
            if best >= LONG_RUN:
                return best, offset  # a run this long isn't worth a search among its own places
        places = self.places.get(buf[at : at + 4], ())
        for seen in reversed(places[-tries:]):
            if at - seen > WINDOW:
                break
            if self.favor_decode and at - seen < 8:
                continue
            if best >= 4 and buf[seen + best : seen + best + 1] != buf[at + best : at + best + 1]:
                continue
            n = 4 + _extend(buf, seen + 4, at + 4, end)
            if n > best:
                best, offset = n, at - seen
        return (best, offset) if offset else (0, 0)

    def _run(self, at: int, end: int) -> tuple[int, int] | None:
        """(length, period) of the repetition of 1, 2 or 4 bytes that goes on at a position, None if there is none of four bytes."""
        buf = self.buf
        for period in (1, 2, 4):
            if at >= period and buf[at - period : at + 4 - period] == buf[at : at + 4]:
                return 4 + _extend(buf, at + 4 - period, at + 4, end), period
        return None

    def wider(self, at: int, least: int, end: int, tries: int, longer_than: int) -> tuple[int, int, int] | None:
        """(start, offset, length) of the longest match that covers four bytes at a position and may start from `least` on; None unless it is longer than the given length.

        Of each of the newest `tries` places both directions count.
        """
        self.fill(at)
        buf, found, best = self.buf, None, longer_than
        for seen in reversed(self.places.get(buf[at : at + 4], ())[-tries:]):
            by = at - seen
            if by > WINDOW:
                break
            if self.favor_decode and by < 8:
                continue
            start = at
            while start > least and start > by and buf[start - 1] == buf[start - 1 - by]:
                start -= 1
            # Longer than the best only if the byte behind the best's length agrees, too.
            reach = start + best
            if reach >= end or reach > at + 3 and buf[reach] != buf[reach - by]:
                continue
            n = at + 4 - start + _extend(buf, seen + 4, at + 4, end)
            if n > best:
                found, best = (start, by, n), n
        return found


def _overlapping(buf: bytes, base: int, tries: int, favor_decode: bool = False) -> list[tuple[int, int, int]]:
    """Parse that looks behind each match for a longer one that overlaps it, and behind that for a third.

    The first is cut where the second starts, if four bytes of it are left, else the second takes its place. A second
    whose third would leave it fewer than four bytes is passed over, and the first reaches up to the third.
    """
    chains, found, at = _Chains(buf, base, favor_decode), [], base
    limit, end = len(buf) - MATCH_LIMIT, len(buf) - LAST_LITERALS
    while at <= limit:
        n, offset = chains.longest(at, end, tries)
        if not n:
            at += 1
            continue
        first, second = (at, offset, n), None
        while True:
            last = second or first
            place = last[0] + last[2] - 2
            third = chains.wider(place, last[0] + 1, end, tries, last[2]) if place <= limit else None
            if third and third[0] > limit:
                third = None
            if not third:
                break
            if second is None:
                first, second = (third, None) if third[0] - first[0] < LEAST_MATCH else (first, third)
            elif third[0] - second[0] < LEAST_MATCH:
                second = third
            else:
                found.append(_cut(first, second[0]))
                first, second = second, third
        found.append(_cut(first, second[0]) if second else first)
        if second:
            found.append(second)
        at = found[-1][0] + found[-1][2]
    return found


def _cut(match: tuple[int, int, int], before: int) -> tuple[int, int, int]:
    return match[0], match[1], min(match[2], before - match[0])


def literals_price(n: int) -> int:
    """Bytes that a run of n literals takes, without its token."""
    return n + (1 + (n - 15) // 255 if n >= 15 else 0)


def sequence_price(n: int, length: int) -> int:
    """Bytes of a sequence of n literals and a match."""
    return 3 + literals_price(n) + (1 + (length - 19) // 255 if length >= 19 else 0)


def _optimal(buf: bytes, base: int, tries: int, favor_decode: bool = False) -> list[tuple[int, int, int]]:
    """Cheapest parse by forward dynamic programming over one match a position and its shorter forms."""
    size = len(buf) - base
    limit, end = len(buf) - MATCH_LIMIT, len(buf) - LAST_LITERALS
    chains = _Chains(buf, base, favor_decode)
    far = 1 << 60
    cost, run, came = [far] * (size + 1), [0] * (size + 1), [(0, 0)] * (size + 1)
    cost[0] = 0
    skip_to = 0
    for k in range(size):
        here = cost[k]
        literal = here + 1 + (1 if run[k] + 1 == 15 or run[k] + 1 > 15 and (run[k] + 1 - 15) % 255 == 0 else 0)
        if literal < cost[k + 1] or literal == cost[k + 1] and came[k + 1][0]:
            cost[k + 1], run[k + 1], came[k + 1] = literal, run[k] + 1, (0, 0)
        at = base + k
        if at > limit or k < skip_to:
            continue
        n, offset = chains.longest(at, end, tries)
        if not n:
            continue
        if n > 1024:  # long enough to be taken as a whole
            lengths, skip_to = (n,), k + n
        else:
            lengths = range(LEAST_MATCH, n + 1)
        for m in lengths:
            price = here + 3 + (1 + (m - 19) // 255 if m >= 19 else 0)
            if price < cost[k + m]:
                cost[k + m], run[k + m], came[k + m] = price, 0, (m, offset)
    found, k = [], size
    while k:
        m, offset = came[k]
        if m:
            found.append((base + k - m, offset, m))
        k -= m or 1
    return found[::-1]


def tries_of(level: int) -> tuple[str, int]:
    """Strategy and number of places searched of a level: 0 and below greedy, 1-2 two distances, 3-9 overlapping, 10-12 optimal; above 12 is 12."""
    level = min(level, MOST_LEVEL)
    if level < 1:
        return "fast", 1
    if level < 3:
        return "mid", 2
    if level < 10:
        return "overlapping", 1 << (level - 1)
    return "optimal", {10: 96, 11: 512, 12: 16384}[level]


def _matches(buf: bytes, base: int, acceleration: int, level: int, favor_decode: bool):
    """Matches (position, offset, length) of buf from base on, by the level's strategy: a list, or the rows of an array."""
    if level < 0:
        level, acceleration = 0, 1 - level
    if len(buf) - base <= MATCH_LIMIT:
        return []
    kind, tries = tries_of(level)
    if kind == "fast":
        return _fast(buf, base, min(max(1, acceleration), MOST_ACCELERATION))
    if kind == "mid":
        found = _mid(buf, base)
    else:
        found = (_overlapping if kind == "overlapping" else _optimal)(buf, base, tries, favor_decode)
    # A match that was grown or cut after it was chosen may again be of a kind that is slow to decode.
    return [(at, by, 18 if 19 <= n <= 36 else n) for at, by, n in found if by >= 8] if favor_decode else found


def encode(data: bytes, acceleration: int = 1, level: int = 0, history: bytes = b"", favor_decode: bool = False) -> bytes:
    """A compressed block of data, whose matches may reach into the last 64 KB of history.

    level 0 is greedy, with `acceleration` (1 to 65537) trading size for speed; level -n is greedy with
    acceleration n + 1. An empty input makes the one-byte block. favor_decode, from level 1 on, avoids matches that
    are slow to decode.
    """
    if len(data) > MOST_INPUT:
        raise ValueError("too much input for a block")
    history = history[-HISTORY:]
    buf, base = history + data, len(history)
    return _write(buf, base, _matches(buf, base, acceleration, level, favor_decode))


def _fitting_literals(room: int) -> int:
    """The longest run of literals that takes at most `room` bytes, without its token."""
    if room < 16:
        return min(room, 14) if room > 0 else 0
    n = room - 1 - (room - 16) // 256
    return n if literals_price(n) <= room else n - 1


def encode_into(data: bytes, room: int, acceleration: int = 1, level: int = 0, history: bytes = b"") -> tuple[bytes, int]:
    """(block of at most `room` bytes, how much of data it holds): as many sequences of one parse as fit, and literals to fill up."""
    if room < 1:
        raise ValueError("a block takes a byte at least")
    history = history[-HISTORY:]
    buf, base = history + data, len(history)
    found = _matches(buf, base, acceleration, level, False)
    ends, sizes, at = [base], [0], base
    for start, _, n in found:
        sizes.append(sizes[-1] + sequence_price(start - at, n))
        at = start + n
        ends.append(at)
    for k in range(len(found), -1, -1):
        left = room - sizes[k] - 1
        if left < 0:
            continue
        stop = min(len(buf), ends[k] + _fitting_literals(left))
        if not k or stop - ends[k] >= LAST_LITERALS and stop - found[k - 1][0] >= MATCH_LIMIT:
            return _write(buf[:stop], base, found[:k]), stop - base
    raise AssertionError("no sequence always fits")


def zero_runs(data: bytes, least: int = 8) -> list[tuple[int, int]]:
    """(start, length) of runs of zero bytes that are at least so long, for sparse files."""
    import re

    return [(m.start(), m.end() - m.start()) for m in re.finditer(rb"\x00{%d,}" % max(1, least), data)]


def pack_messages(messages: list[bytes], width: int = 4, level: int = 0, linked: bool = True, dictionary: bytes = b"") -> bytes:
    """Messages as blocks behind their little-endian lengths of `width` bytes, each with those before as history if linked, the dictionary before all."""
    out, history = bytearray(), dictionary[-HISTORY:]
    for m in messages:
        packed = encode(m, level=level, history=history)
        out += len(packed).to_bytes(width, "little") + packed
        if linked:
            history = (history + m)[-HISTORY:]
    return bytes(out)


def unpack_messages(data: bytes, width: int = 4, linked: bool = True, dictionary: bytes = b"") -> list[bytes]:
    """The messages of pack_messages."""
    found, history, at = [], dictionary[-HISTORY:], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + width], "little")
        if at + width + n > len(data):
            raise BlockError("a truncated message", at)
        found.append(decode(data[at + width : at + width + n], history=history))
        if linked:
            history = (history + found[-1])[-HISTORY:]
        at += width + n
    return found
