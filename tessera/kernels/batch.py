"""The block codec over many blocks at once: the places, lengths and sequences of a batch are arrays, as single small blocks leave arrays short.

A batch is one buffer of segments, each of which becomes a block: the bytes [base, stop), whose matches may reach back to `floor`, the
same for all segments of a stream, and into a dictionary that lies before every stream (and once at the front of the buffer).
The parses are those of ``block``; what they search is found beforehand for all places of the batch.
"""

from __future__ import annotations

import numpy as np

from . import block
from .block import LEAST_MATCH, LONG_RUN, STEPS, WINDOW, _extend, _ranges

#: Bytes that are laid out at once; a larger cell is a batch by itself.
PIECE = 1 << 18
#: Rounds of eight bytes by which lengths are counted for all places; longer matches go on by diagonals.
ROUNDS = 6
#: Places for each further try below which a search goes on place by place.
FEW = 4


class Batch:
    """A buffer of segments, its four-byte places in order, and the earlier places of each."""

    def __init__(self, buf: bytes, floors, bases, stops, dictionary: int = 0):
        self.buf, self.h, n = buf, dictionary, len(buf)
        self.floors, self.bases, self.stops = (np.asarray(x, np.int32) for x in (floors, bases, stops))
        self.data = np.frombuffer(buf, np.uint8)
        padded = np.frombuffer(buf + bytes(16), np.uint8)
        self.words = np.ndarray((n + 8,), "<u8", padded, strides=(1,)).copy()
        sizes = self.stops - self.bases
        own = _ranges(self.bases.astype(np.int64), sizes)
        self.end = np.zeros(n + 1, np.int32)  # where a place's matches end at most; 0 outside of segments
        self.end[own] = np.repeat(self.stops - block.LAST_LITERALS, sizes)
        self.floor = np.zeros(n + 1, np.int32)
        first = np.unique(self.floors)
        self.floor[first] = first
        self.floor = np.maximum.accumulate(self.floor)
        self.starts = np.zeros(n + 1, bool)
        able = np.maximum(sizes - block.MATCH_LIMIT + 1, 0)  # the last 12 bytes start no match
        self.starts[_ranges(self.bases.astype(np.int64), able)] = True
        self.order, same = _in_order(self.words[: max(0, n - 3)], 4, None)
        self.index(same)

    def index(self, same: np.ndarray) -> None:
        """The places of a group that a place can see: `own` ones before it in its stream, and the dictionary's up to `last`."""
        order, n = self.order, len(self.order)
        here = np.arange(n, dtype=np.int32)
        stream = same & (self.floor[order[1:]] == self.floor[order[:-1]]) if n else same
        first = np.zeros(n, np.int32)
        first[1:] = np.where(stream, 0, here[1:])
        self.own = here - np.maximum.accumulate(first)
        self.last = None
        if self.h:
            inside = order <= self.h - 4
            group = np.zeros(n, np.int32)
            group[1:] = np.where(same, 0, here[1:])
            group = np.maximum.accumulate(group)
            last = np.maximum.accumulate(np.where(inside, here, -1))
            self.own[self.floor[order] == 0] = 0  # the dictionary's own places are no one's
            self.last, self.known = last, np.where(inside, 0, np.maximum(last - group + 1, 0))

    def seen(self, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k-th newest place that the places at these indexes of the order see, and their distance."""
        if self.last is None:
            place = self.order[at - k]
            return place, self.order[at] - place
        p, own = self.order[at], self.own[at]
        inside = k > own
        place = self.order[np.where(inside, self.last[at] - (k - own - 1), at - k)]
        return place, np.where(inside, p - self.floor[p] + self.h - place, p - place)

    def count(self) -> np.ndarray:
        return self.own if self.last is None else self.own + self.known

    def cap(self, p: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where a match from p ends at most: a segment's last bytes are literals, and the dictionary ends where it ends."""
        end = self.end[p]
        return end if not self.h else np.where(place < self.h, np.minimum(end, p + self.h - place), end)

    def lengths(self, p: np.ndarray, place: np.ndarray, cap: np.ndarray) -> np.ndarray:
        """How many bytes from p equal those from place, of which four do, up to where p's match may end."""
        most = cap - p
        n = np.full(len(p), LEAST_MATCH, np.int32)
        live = np.arange(len(p), dtype=np.int32)
        a, b = p + LEAST_MATCH, place + LEAST_MATCH
        for _ in range(ROUNDS):
            x = self.words[a] ^ self.words[b]
            n[live] += (np.bitwise_count((x & -x) - np.uint64(1)) >> 3).astype(np.int32)
            on = (x == 0) & (n[live] < most[live])
            live = live[on]
            if not len(live):
                break
            a, b = a[on] + 8, b[on] + 8
        if len(live):
            self._diagonals(p, place, cap, n, live)
        return np.minimum(n, most)

    def _diagonals(self, p, place, cap, n, live) -> None:
        """Goes on with long matches: those of one distance that follow one another end at the same byte."""
        live = live[np.lexsort((p[live], p[live] - place[live]))]
        own, by, to = p[live], p[live] - place[live], cap[live]
        new = np.ones(len(live), bool)
        new[1:] = (own[1:] != own[:-1] + 1) | (by[1:] != by[:-1]) | (to[1:] != to[:-1])
        heads, ends, before = np.flatnonzero(new), [], (0, 0, 0)
        for q, d, top, done in zip(own[heads].tolist(), by[heads].tolist(), to[heads].tolist(), n[live[heads]].tolist()):
            if not (before[0] == d and before[1] == top and q < before[2]):
                before = d, top, q + done + _extend(self.buf, q + done - d, q + done, top)
            ends.append(before[2])
        n[live] = np.repeat(np.array(ends, np.int32), np.diff(np.append(heads, len(live)))) - own

    def newest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places that can start a match with the newest place that each sees, that place, the distance)."""
        at = np.flatnonzero((self.count() > 0) & self.starts[self.order])
        place, by = self.seen(at, 1)
        p, near = self.order[at], by <= WINDOW
        return p[near], place[near], by[near]

    def longest(self, tries: int) -> tuple[np.ndarray, np.ndarray]:
        """(length, distance) of each place's longest match among the newest `tries` places that it sees, 0 where there is none."""
        length, distance = np.zeros(len(self.data) + 1, np.int32), np.zeros(len(self.data) + 1, np.int32)
        count = np.minimum(self.count(), tries)
        at = np.flatnonzero((count > 0) & self.starts[self.order])
        best, k = np.full(len(at), LEAST_MATCH - 1, np.int32), 1
        grams, room = self.words.astype(np.uint32), count[at]
        while len(at):
            if k > 1 and len(at) < FEW * (int(room.max()) - k + 1):
                self._one_by_one(at, k, room, best, grams, length, distance)
                break
            place, by = self.seen(at, k)
            p = self.order[at]
            near = by <= WINDOW
            like = np.flatnonzero(near & (grams[place + (best - 3)] == grams[p + (best - 3)]))
            q = p[like]
            cap = self.cap(q, place[like])
            n = self.lengths(q, place[like], cap)
            more = n > best[like]
            some, q = like[more], q[more]
            best[some] = n[more]
            length[q], distance[q] = n[more], by[some]
            k += 1
            # Nothing is longer than to the end, and a long repetition isn't worth a search among its own places.
            on = near & (room >= k) & (p + best < self.end[p])
            on[some[(n[more] >= LONG_RUN) & (by[some] <= n[more])]] = False
            at, best, room = at[on], best[on], room[on]
        return length, distance

    def _one_by_one(self, at, k, room, best, grams, length, distance) -> None:
        for i, most, longest in zip(at.tolist(), room.tolist(), best.tolist()):
            p = int(self.order[i])
            if self.last is None:
                places = self.order[i - most : i - k + 1][::-1]
                by = p - places
            else:
                places, by = self.seen(np.full(most - k + 1, i), np.arange(k, most + 1))
            end = int(self.end[p])
            places = places[by <= WINDOW]
            by = by[: len(places)]
            while len(places) and p + longest < end:
                like = np.flatnonzero(grams[places + (longest - 3)] == grams[p + longest - 3])
                found = None
                for j in like.tolist():
                    c = int(places[j])
                    top = min(end, p + self.h - c) if c < self.h else end
                    n = LEAST_MATCH + _extend(self.buf, c + LEAST_MATCH, p + LEAST_MATCH, top) if top > p + LEAST_MATCH else top - p
                    if n > longest:
                        longest, found = n, j
                        length[p], distance[p] = n, by[j]
                        break
                if found is None:
                    break
                places, by = places[found + 1 :], by[found + 1 :]


def _in_order(words: np.ndarray, width: int, grams) -> tuple[np.ndarray, np.ndarray]:
    """(places in the order of their `width` bytes, then of themselves; whether each has the bytes of the one before it)."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, bool)
    if n <= 1 << 20:
        key = words & np.uint64(0xFFFFFFFF)
        if width == 7:  # the number of the four bytes, and three more
            order, same = grams
            number = np.zeros(len(order), np.uint64)
            number[order[1:]] = np.cumsum(~same)
            key = number[:n] << np.uint64(24) | words >> np.uint64(32) & np.uint64(0xFFFFFF)
        key = np.sort(key << np.uint64(20) | np.arange(n, dtype=np.uint64))
        return (key & np.uint64(0xFFFFF)).astype(np.int32), key[1:] >> np.uint64(20) == key[:-1] >> np.uint64(20)
    own = words & np.uint64((1 << 8 * width) - 1)
    order = np.argsort(own, kind="stable").astype(np.int32)
    return order, own[order[1:]] == own[order[:-1]]


def _greedy(b: Batch, acceleration: int):
    """block._fast over a batch."""
    n = len(b.data)
    p, place, by = b.newest()
    distance, behind, delta = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32)
    distance[p], delta[p] = by, p - place
    if acceleration > 1:
        base = np.zeros(n + 1, np.int32)
        base[b.bases] = b.bases
        base = np.maximum.accumulate(base)
        on = (p - base[p]) % acceleration == 0
        p, place = p[on], place[on]
    # Neighbours of one distance are one match. Places that start none have no distance here, and end a row of neighbours.
    places = np.arange(n + 1, dtype=np.int32)
    stops = np.minimum.accumulate(np.where(np.append(distance[1:] != distance[:-1], True), places, np.int32(n))[::-1])[::-1]
    cap = np.zeros(n + 1, np.int32)
    cap[p] = b.cap(p, place)
    behind[p] = np.minimum(stops[p] + LEAST_MATCH, cap[p])
    some = p
    for _ in range(STEPS):
        stop = behind[some]
        on = stop < cap[some]
        some, stop = some[on], stop[on]
        some = some[b.data[stop] == b.data[stop - delta[some]]]
        if not len(some):
            break
        behind[some] += 1
    longer = set(some.tolist())
    starts = np.zeros(n + 1, bool)
    starts[p] = True
    following = memoryview(np.minimum.accumulate(np.where(starts, places, np.int32(n))[::-1])[::-1].copy())
    ends, found, at = memoryview(behind), [], 0
    while True:
        at = following[at]
        if at >= n:
            break
        found.append(at)
        if at in longer:
            stop = ends[at]
            behind[at] = stop + _extend(b.buf, stop - int(delta[at]), stop, int(cap[at]))
        at = ends[at]
    at = np.array(found, np.int64)
    return at, distance[at], behind[at] - at


def _two_distances(b: Batch):
    """block._mid over a batch."""
    n = len(b.data)
    lengths, by, source = ([np.zeros(n + 1, np.int32) for _ in range(2)] for _ in range(3))
    grams = b.order, np.append(False, b.words[b.order[1:]].astype(np.uint32) == b.words[b.order[:-1]].astype(np.uint32))[1:]
    for k in (0, 1):
        if k:
            b.order, same = _in_order(b.words[: max(0, n - 6)], 7, grams)
            b.index(same)
        p, place, distance = b.newest()
        if k and b.h:  # seven bytes of the dictionary lie in it as a whole
            inside = place > b.h - 7
            inside &= place < b.h
            p, place, distance = p[~inside], place[~inside], distance[~inside]
        lengths[k][p], by[k][p], source[k][p] = b.lengths(p, place, b.cap(p, place)), distance, place
    first = np.where(by[1] > 0, 1, 0)
    near = np.flatnonzero((by[0] > 0) | (by[1] > 0))
    length, distance, origin = (np.where(first, x[1], x[0]) for x in (lengths, by, source))
    # A match by four gives way to a longer one by seven that starts a byte later.
    late = np.zeros(n + 1, bool)
    late[:-1] = (first[:-1] == 0) & (by[0][:-1] > 0) & (first[1:] == 1) & (lengths[1][1:] > lengths[0][:-1])
    late, length, distance, origin = memoryview(late), memoryview(length), memoryview(distance), memoryview(origin)
    bases, lowest, buf, h = b.bases.tolist(), b.floors.tolist(), b.buf, b.h
    segment = np.searchsorted(b.bases, near, "right") - 1
    found, anchor, now = [], 0, -1
    for at, s in zip(near.tolist(), segment.tolist()):
        if s != now:
            now, anchor, floor = s, bases[s], lowest[s]
        if at < anchor:
            continue
        if late[at]:
            at += 1
        m, d, c = length[at], distance[at], origin[at]
        low = 0 if c < h else floor
        while at > anchor and c > low and buf[at - 1] == buf[c - 1]:
            at, c, m = at - 1, c - 1, m + 1
        found.append((at, d, m))
        anchor = at + m
    found = np.array(found, np.int64).reshape(-1, 3)
    return found[:, 0], found[:, 1], found[:, 2]


def _overlapping(b: Batch, tries: int):
    """block._overlapping over a batch; what starts behind a match's start and reaches beyond its end is a look into the lengths."""
    length, distance = b.longest(tries)
    some = np.flatnonzero(length)
    following = np.full(len(length), len(length), np.int32)
    following[some] = some
    following = memoryview(np.minimum.accumulate(following[::-1])[::-1].copy())
    n, found, lengths, at, whole = length.tolist(), [], [], 0, len(length)
    while True:
        at = following[at]
        if at >= whole:
            break
        first, m, second, k = at, n[at], -1, 0
        while True:
            last, reach = (second, k) if second >= 0 else (first, m)
            ahead = n[last + 1 : last + reach - 1]
            longest = max(ahead, default=0)
            if longest <= reach:
                break
            third = last + 1 + ahead.index(longest)
            if second < 0:
                if third - first < LEAST_MATCH:
                    first, m = third, longest
                else:
                    second, k = third, longest
            elif third - second < LEAST_MATCH:
                second, k = third, longest
            else:
                found.append(first)
                lengths.append(min(m, second - first))
                first, m, second, k = second, k, third, longest
        if second < 0:
            found.append(first)
            lengths.append(m)
            at = first + m
        else:
            found += first, second
            lengths += min(m, second - first), k
            at = second + k
    at = np.array(found, np.int64)
    return at, distance[at], np.array(lengths, np.int64)


def _cheapest(b: Batch, tries: int):
    """block._optimal over a batch, from the last byte to the first: the cheapest way from a place on is a least cost among those that its matches reach."""
    length, distance = b.longest(tries)
    found, lengths = [], []
    for base, stop in zip(b.bases.tolist(), b.stops.tolist()):
        size = stop - base
        if size <= block.MATCH_LIMIT:
            continue
        n = length[base:stop].tolist()
        cost, taken = [0] * (size + 1), [0] * size
        run, here = 0, 0
        for k in range(size - 1, -1, -1):
            run += 1
            here += 2 if run == 15 or run > 15 and not (run - 15) % 255 else 1
            most = n[k]
            if most:
                if most > 1024:  # long enough to be taken as a whole
                    price = 4 + (most - 19) // 255 + cost[k + most]
                    if price <= here:
                        here, run, taken[k] = price, 0, most
                else:
                    ahead = cost[k + 4 : k + min(most, 18) + 1]
                    price = min(ahead)
                    if price + 3 <= here:
                        here, run, taken[k] = price + 3, 0, 4 + ahead.index(price)
                    first = 19
                    while first <= most:
                        ahead = cost[k + first : k + min(most, first + 254) + 1]
                        price = min(ahead) + 4 + (first - 19) // 255
                        if price < here:
                            here, run, taken[k] = price, 0, first + ahead.index(min(ahead))
                        first += 255
            cost[k] = here
        k = 0
        while k < size:
            m = taken[k]
            if m:
                found.append(base + k)
                lengths.append(m)
            k += m or 1
    at = np.array(found, np.int64)
    return at, distance[at], np.array(lengths, np.int64)


def _written(b: Batch, at, by, length) -> list[bytes]:
    """The blocks of all segments from their matches, in ascending order, laid out as arrays; each ends with its last literals."""
    segments = len(b.bases)
    at, by, length = (np.asarray(x, np.int64) for x in (at, by, length))
    own = np.searchsorted(b.bases, at, "right") - 1
    per = np.bincount(own, minlength=segments)
    total = len(at) + segments
    last = np.cumsum(per + 1) - 1
    matched = np.ones(total, bool)
    matched[last] = False
    place, offset, n_match = np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros(total, np.int64)
    place[matched], offset[matched], n_match[matched] = at, by, length
    place[last] = b.stops
    anchor = np.zeros(total, np.int64)
    anchor[1:] = (place + n_match)[:-1]
    anchor[np.append(0, last[:-1] + 1)] = b.bases
    n, m = place - anchor, n_match - LEAST_MATCH
    n_more, m_more = np.where(n >= 15, (n - 15) // 255 + 1, 0), np.where(m >= 15, (m - 15) // 255 + 1, 0)
    size = 1 + n + n_more + np.where(matched, 2 + m_more, 0)
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    out[start] = np.minimum(n, 15) << 4 | np.clip(m, 0, 15)
    literal = start + 1 + n_more
    for value, more, first in ((n, n_more, start + 1), (m, m_more, literal + n + 2)):
        some = more > 0
        if some.any():
            out[_ranges(first[some], more[some])] = 255
            out[(first + more - 1)[some]] = (value[some] - 15) % 255
    out[_ranges(literal, n)] = b.data[_ranges(anchor, n)]
    behind = (literal + n)[matched]
    out[behind], out[behind + 1] = by & 255, by >> 8
    whole, ends = out.tobytes(), (start + size)[last].tolist()
    return [whole[a:z] for a, z in zip([0, *ends], ends)]


def _found(b: Batch, acceleration: int, level: int):
    """(places, distances, lengths) of a batch's matches, by the level's strategy."""
    if level < 0:
        level, acceleration = 0, 1 - level
    kind, tries = block.tries_of(level)
    if kind == "fast":
        return _greedy(b, min(max(1, acceleration), block.MOST_ACCELERATION))
    if kind == "mid":
        return _two_distances(b)
    return (_overlapping if kind == "overlapping" else _cheapest)(b, tries)


def encode_segments(buf: bytes, floors, bases, stops, acceleration: int = 1, level: int = 0, dictionary: int = 0) -> list[bytes]:
    """A compressed block for each segment of a buffer, which begins with `dictionary` bytes that all streams may refer to."""
    b = Batch(buf, floors, bases, stops, dictionary)
    return _written(b, *_found(b, acceleration, level))


def _encode_large(data: bytes, lead: bytes, acceleration: int, level: int, dictionary: bytes) -> bytes:
    """One block of data behind `lead`, laid out a piece at a time, with the 64 KB before it; no match crosses pieces."""
    whole, found = lead + data, []
    for first in range(len(lead), len(whole), PIECE):
        low = max(0, first - block.HISTORY)
        front = b"" if low else dictionary
        buf = front + whole[low : first + PIECE]
        b = Batch(buf, [len(front)], [len(front) + first - low], [len(buf)], len(front))
        at, by, length = _found(b, acceleration, level)
        found.append(np.stack([at + (low - len(front) - len(lead)), by, length], axis=1))
    return block._write(data, 0, np.concatenate(found))


def pieces(sizes, most: int = PIECE):
    """(first, last) of neighbours that together have at most so many bytes; a larger one is alone."""
    first, total = 0, 0
    for k, n in enumerate(sizes):
        if k > first and total + n > most:
            yield first, k
            first, total = k, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def encode_streams(raws: list[bytes], fresh: list[bool], acceleration: int = 1, level: int = 0, dictionary: bytes = b"", before: bytes = b"") -> list[bytes]:
    """A compressed block of each, whose matches may reach into those before it back to the last `fresh` one, and into the dictionary before that.

    `before` is what the first one continues unless it is fresh: the last 64 KB of its stream.
    """
    if any(len(r) > block.MOST_INPUT for r in raws):
        raise ValueError("too much input for a block")
    dictionary, tail, out = dictionary[-block.HISTORY :], before[-block.HISTORY :], []
    h = len(dictionary)
    for first, last in pieces([len(r) for r in raws]):
        some, new = raws[first:last], np.asarray(fresh[first:last], bool)
        lead = b"" if new[0] else tail
        if len(some[0]) > PIECE:
            out.append(_encode_large(some[0], lead, acceleration, level, dictionary))
        else:
            ends = h + len(lead) + np.cumsum([len(r) for r in some])
            starts = np.append(h + len(lead), ends[:-1])
            floors = np.maximum.accumulate(np.where(new, starts, h))
            out += encode_segments(dictionary + lead + b"".join(some), floors, starts, ends, acceleration, level, h)
        again = np.flatnonzero(new)
        tail = b"".join(some[again[-1] :] if len(again) else [lead, *some])[-block.HISTORY :]
    return out


def encode_many(datas: list[bytes], acceleration: int = 1, level: int = 0, dictionary: bytes = b"") -> list[bytes]:
    """block.encode of each, behind the same dictionary."""
    return encode_streams(datas, [True] * len(datas), acceleration, level, dictionary)


def _chain(packed: list[bytes]):
    """(bytes of all blocks, where each sequence's literals are, how many, its match's length, its distance, the blocks' last sequences); None if one is damaged.

    As block._decode_arrays reads a block: every place as if a sequence began there.
    """
    if min(map(len, packed)) < 1:
        return None
    data = b"".join(packed)
    n = len(data)
    raw = np.frombuffer(data, np.uint8)
    block_end = np.cumsum([len(p) for p in packed])
    end = np.empty(n + 3, np.int32)
    end[:n] = np.repeat(block_end, [len(p) for p in packed])
    end[n:] = n
    d = np.zeros(n + 3, np.int32)
    d[:n] = raw
    here = np.arange(n + 3, dtype=np.int32)
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
    following = np.where(long, last[behind] + 1, behind)
    end = end[:n]
    final = stop >= end
    step = memoryview(np.ascontiguousarray(np.where(final, end, np.minimum(following, end)), np.int32))
    at, places = 0, []
    while at < n:
        places.append(at)
        at = step[at]
    chain = np.array(places, np.int32)
    final = final[chain]
    if (stop[chain][final] != end[chain][final]).any() or (following[chain] >= end[chain])[~final].any():
        return None
    n_literal, literal = n_literal[chain].astype(np.int64), literal[chain].astype(np.int64)
    n_match = np.where(final, 0, n_match[chain]).astype(np.int64)
    places = stop[chain].astype(np.int64)
    by = np.where(final, 0, d[places] | d[np.minimum(places + 1, n + 2)] << 8).astype(np.int64)
    return (raw, literal, n_literal, n_match, by, np.flatnonzero(final)) if np.count_nonzero(final) == len(packed) and by[~final].all() else None


def sequences_many(packed: list[bytes]):
    """(block, number in it, literals, distance, match length) of the sequences of all blocks, as arrays; a block's last has 0 for the latter two. None if one is damaged."""
    if not packed:
        return (np.zeros(0, np.int64),) * 5
    found = _chain(packed)
    if found is None:
        return None
    _, _, n_literal, n_match, by, lasts = found
    per = np.diff(np.append(-1, lasts))
    own = np.repeat(np.arange(len(packed)), per)
    return own, np.arange(len(by)) - np.repeat(lasts + 1 - per, per), n_literal, by, n_match


def decode_streams(packed: list[bytes], fresh: list[bool], dictionary: bytes = b"", most: list[int] | None = None) -> list[bytes] | None:
    """The bytes of blocks of which each continues the one before it unless it is `fresh`; None if any is damaged, or they are too large to be laid out.

    Fresh ones, and what they are continued by, have the dictionary before them.
    """
    if not packed:
        return []
    found = _chain(packed)
    if found is None:
        return None
    (raw, literal, n_literal, n_match, by, lasts), h = found, len(dictionary)
    ends = h + np.cumsum(n_literal + n_match)
    total = int(ends[-1])
    if total > block.ARRAYS_MOST:
        return None
    tops = ends[lasts]  # where each block's bytes end
    bottoms = np.append(h, tops[:-1])
    if most is not None and (tops - bottoms > np.asarray(most)).any():
        return None
    begins = np.maximum.accumulate(np.where(np.asarray(fresh, bool), bottoms, h))  # of each block's stream
    begin = np.repeat(begins, np.diff(np.append(-1, lasts)))
    starts = ends - n_match
    matched = n_match > 0
    by = by[matched]
    if (by > (starts - begin)[matched] + h).any():
        return None
    out = np.empty(total, np.uint8)
    out[:h] = np.frombuffer(dictionary, np.uint8)
    out[_ranges(starts - n_literal, n_literal)] = raw[_ranges(literal, n_literal)]
    copied = _ranges(starts[matched], n_match[matched]).astype(np.int32)
    if len(copied):
        source = copied - np.repeat(by, n_match[matched]).astype(np.int32)
        if h:
            floor = np.repeat(begin[matched], n_match[matched]).astype(np.int32)
            source = np.where(source < floor, source - floor + h, source)  # before a stream lies the dictionary
        pointer = np.arange(total, dtype=np.int32)
        while True:
            pointer[copied] = source
            further = pointer[source]
            if (further == source).all():
                break
            source = further
        out[copied] = out[source]
    whole, tops = out.tobytes(), tops.tolist()
    return [whole[a:z] for a, z in zip([h, *tops], tops)]


def decode_many(packed: list[bytes], most: int | None = None, dictionary: bytes = b"", failed=None) -> list[bytes | None]:
    """block.decode of each; `failed` gets the BlockError of one that can't be decoded, which is null then, and without it the error is raised."""
    dictionary, out = dictionary[-block.HISTORY :], []
    for first, last in pieces([len(p) for p in packed], PIECE // 2):
        some = packed[first:last]
        whole = decode_streams(some, [True] * len(some), dictionary, None if most is None else [most] * len(some)) if last - first > 1 else None
        if whole is None:
            whole = []
            for p in some:
                try:
                    whole.append(block.decode(p, most, dictionary))
                except block.BlockError as e:
                    if failed is None:
                        raise
                    failed(e)
                    whole.append(None)
        out += whole
    return out
