import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.kernels import block, frames, generators, hashing

LEVELS = (-20, 0, 1, 2, 3, 9, 10, 12)
EDGES = [b"", b"a", b"a" * 4, b"a" * 11, b"a" * 12, b"a" * 13, bytes(64), b"ab" * 40, b"abc" * 50, b"abcdefg" * 30, bytes(range(256)) * 2]
EDGES += [os.urandom(n) + b"z" * m + os.urandom(5) for n in (14, 15, 16, 269, 270, 271, 280) for m in (4, 18, 19, 20, 273, 274, 275)]


@pytest.mark.parametrize("level", LEVELS)
def test_edges_round_trip(level):
    for raw in [*EDGES, bytes(65536), bytes(65548), generators.noise(65547, 3, 0.6)]:
        packed = block.encode(raw, level=level)
        assert block.decode(packed, len(raw)) == raw
        assert len(packed) <= block.compress_bound(len(raw))


def test_known_blocks():
    assert block.encode(b"") == b"\0"
    assert block.encode(b"a" * 12)[0] >> 4 == 12
    assert block.encode(b"a" * 13).hex() == "136101005" + "06161616161"
    assert block.decode(bytes.fromhex("13610100506161616161")) == b"a" * 13


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400) | st.text(alphabet="ab ", max_size=400).map(str.encode), st.binary(max_size=300), st.sampled_from(LEVELS))
def test_any_bytes_round_trip(raw, history, level):
    packed = block.encode(raw, level=level, history=history)
    assert block.decode(packed, len(raw), history) == raw
    found = block.sequences(packed)
    assert sum(len(s.literals) + (s.match_len or 0) for s in found) == len(raw)
    assert found[-1].offset is None and all(1 <= s.offset <= 65535 and s.match_len >= 4 for s in found[:-1])


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcd ", min_size=1, max_size=600).map(str.encode))
def test_end_rules(raw):
    at = 0
    found = block.sequences(block.encode(raw, level=9))
    for s in found[:-1]:
        at += len(s.literals)
        assert at <= len(raw) - 12
        at += s.match_len
        assert at <= len(raw) - 5
    assert len(found) == 1 or len(found[-1].literals) >= 5


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=80))
def test_noise_fails_only_as_block_error(data):
    for call in (lambda: block.decode(data, 1000), lambda: block.sequences(data), lambda: block.decode(data, 1000, target=10)):
        try:
            call()
        except block.BlockError as e:
            assert 0 <= e.position <= len(data)


@pytest.mark.parametrize(("data", "reason"), [
    (b"", "an empty block"), (b"\x10", "literals run past"), (b"\xf0", "a length runs past"), (b"\x10a\0\0", "an offset outside"), (b"\x10a\x02\0", "an offset outside"),
    (b"\x10a\x01", "a truncated offset"), (b"\x10a\x01\0", "no last literals"), (b"\x50abcd", "literals run past"),
])
def test_bad_blocks(data, reason):
    with pytest.raises(block.BlockError, match=reason):
        block.decode(data)


def test_output_bound_and_partial_decoding():
    raw = generators.words(5000, 1).encode()
    packed = block.encode(raw)
    with pytest.raises(block.BlockError, match="more bytes"):
        block.decode(packed, len(raw) - 1)
    for target in (0, 1, 100, 4999, 5000, 9000):
        assert block.decode(packed, target=target) == raw[:target]
    assert block.decode(packed[: len(packed) // 2], target=500) == raw[:500]


def test_filling_a_room():
    raw = generators.words(20_000, 2).encode()
    for room in (1, 2, 50, 3000, 100_000):
        packed, used = block.encode_into(raw, room)
        assert len(packed) <= room and block.decode(packed) == raw[:used]
    assert used == len(raw)


def _corpus(n):
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).to_pylist()
    return "\n".join(t for t in texts if t).encode()[:n]


@pytest.mark.parametrize("make", [lambda: generators.words(30_000, 4).encode(), lambda: _corpus(60_000), lambda: generators.noise(30_000, 2, 0.7)])
def test_levels_and_history_help(make):
    raw = make()
    sizes = [len(block.encode(raw, level=k)) for k in (-50, 0, 2, 3, 9, 12)]
    assert all(a >= b for a, b in zip(sizes, sizes[1:])), sizes
    assert len(block.encode(raw[:2000], history=raw[2000:])) < len(block.encode(raw[:2000]))
    assert block.tries_of(99) == block.tries_of(12) and block.tries_of(-3)[0] == "fast"


def test_distances_to_the_last_place_of_some_bytes():
    raw = generators.noise(3000, 9, 0.7) + b"abababababab" * 3
    for width in (4, 7):
        seen, expected = {}, []
        for i in range(len(raw) - width + 1):
            expected.append(i - seen[raw[i : i + width]] if raw[i : i + width] in seen else 0)
            seen[raw[i : i + width]] = i
        assert block._previous(raw, width)[: len(expected)].tolist() == expected


@settings(max_examples=80, deadline=None)
@given(st.binary(min_size=300, max_size=900) | st.text(alphabet="abc ", min_size=700, max_size=3000).map(str.encode), st.binary(max_size=200), st.integers(0, 10**6))
def test_blocks_decode_alike_by_arrays_and_step_by_step(raw, history, place):
    """Whole, damaged and bounded blocks: the same bytes or the same error."""
    packed = bytearray(block.encode(raw, history=history))
    for damage in (False, True):
        if damage:
            packed[place % len(packed)] ^= 1 << place % 8
        for most in (None, len(raw), len(raw) - 1):
            told = []
            for least in (1, 1 << 30):
                block.ARRAYS_FROM = least
                try:
                    told.append(block.decode(bytes(packed), most, history))
                except block.BlockError as e:
                    told.append((e.reason, e.position))
                finally:
                    block.ARRAYS_FROM = 200
            assert told[0] == told[1]


def test_runs_are_found_without_a_search():
    for period in (b"a", b"ab", b"abcd"):
        raw = os.urandom(30) + period * 20_000 + b"end of it, and more"
        assert len(block.encode(raw, level=12)) < 450
        at = 30 + 4 * len(period)
        chains = block._Chains(raw, 0)
        assert chains._run(at, len(raw) - 5)[1] == len(period) and chains._run(20, len(raw) - 5) is None


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc ", max_size=700).map(str.encode), st.integers(1, 300), st.sampled_from((0, 2, 9, 12)))
def test_any_room_is_kept(raw, room, level):
    packed, used = block.encode_into(raw, room, level=level, history=b"abc " * 9)
    assert len(packed) <= room and block.decode(packed, history=b"abc " * 9) == raw[:used]
    assert used == len(raw) or used >= room - 2 - room // 255
    found, at = block.sequences(packed), 0
    for s in found[:-1]:
        at += len(s.literals)
        assert at <= used - 12
        at += s.match_len
        assert at <= used - 5


@pytest.mark.parametrize(("size", "block_id"), [(31, 4), (32, 4), (65535, 4), (65536, 4), (65537, 5), (262144, 5), (262145, 6), (1048576, 6), (1048577, 7), (10485760, 7)])
def test_custom_block_sizes(size, block_id):
    """Sizes and ids that the command line's own test expects, too large and too small ones clamped."""
    cut = min(max(size, 32), 4 << 20)
    raw = os.urandom(1000) * (2 * cut // 1000 + 2)
    for independent in (True, False):
        one = frames.encode(raw, frames.Options(independent=independent, store=True, block_size=size))
        found = list(frames.frames(one + one))
        assert len(found) == 2 and all(f.block_id == block_id and f.independent == independent and f.payload == raw for f in found)
        assert {n for _, n, _ in found[0].blocks[:-1]} == {cut}
    packed = frames.encode(raw[:5000], frames.Options(independent=False, block_size=size))
    assert frames.decode(packed) == raw[:5000]


def test_low_levels_of_frames_are_greedy():
    raw = generators.words(20_000, 7).encode()
    same = [frames.encode(raw, frames.Options(level=k)) for k in (0, 1)]
    assert same[0] == same[1] != frames.encode(raw, frames.Options(level=2))
    assert frames.legacy(raw, 2) == frames.legacy(raw) != frames.legacy(raw, 3)


@pytest.mark.parametrize("options", [frames.Options(4), frames.Options(4, False, True, True), frames.Options(independent=False, block_size=1000, dict_id=3)])
def test_frames_block_by_block(options):
    import io

    class Out(io.BytesIO):
        def close(self):
            pass

    raw, asked = generators.words(300_000, 3).encode(), []
    out = Out()
    writer = frames.FrameWriter(out, options, len(raw), raw[:500])
    for at in range(0, len(raw), 777):
        writer.add(raw[at : at + 777])
    writer.close()
    file = out.getvalue() + frames.skippable(b"x" * 100_000) + frames.legacy(raw[:100])

    def read(at, n):
        asked.append(n)
        return file[at : at + n]

    view = frames.View(read, len(file), 4096)
    got = [(f.kind, data) for f, data in frames.blocks(view, dictionary=raw[:500])]
    assert b"".join(d for k, d in got if k == "standard" and d is not None) == raw and got[-2] == ("legacy", raw[:100])
    assert max(asked) <= max(options.cut, 4096)
    assert frames.decode(file, raw[:500]) == raw + raw[:100]
    asked.clear()
    heads = [f for f, data in frames.blocks(view, decode=False) if data is None]
    assert [f.kind for f in heads] == ["standard", "skippable", "legacy"] and max(asked) <= 4096
    assert frames.decode(frames.encode(b"", options)) == b""


def test_some_data_of_a_frame_are_stored():
    import io

    class Out(io.BytesIO):
        def close(self):
            pass

    raw, out = generators.words(9000, 1).encode(), Out()
    writer = frames.FrameWriter(out, frames.Options(4, False, True))
    writer.add(raw[:3000])
    before = len(out.getvalue())
    writer.flush()
    assert len(out.getvalue()) > before and len(list(frames.blocks(out.getvalue() + bytes(8), decode=False))) == 2
    writer.add(raw[3000:6000], store=True)
    writer.add(raw[6000:], store=False)
    writer.close()
    (frame,) = frames.frames(out.getvalue())
    assert frame.payload == raw and [stored for _, _, stored in frame.blocks] == [False, True, False] and frame.blocks[1][1] == 3000


def test_prices_are_sizes():
    for n in (0, 1, 14, 15, 16, 269, 270, 271):
        assert block.literals_price(n) == len(block.encode(os.urandom(n))) - 1 if n <= 12 else True
    assert block.sequence_price(0, 4) == 3 and block.sequence_price(15, 19) == 3 + 16 + 1 and block.sequence_price(14, 273) == 3 + 14 + 1 and block.sequence_price(0, 274) == 5


def test_messages():
    messages = [b"", b"hello hello hello", b"hello hello again", generators.words(90_000, 1).encode(), b"the end"]
    for width, linked in ((4, True), (4, False)):
        assert block.unpack_messages(block.pack_messages(messages, width, linked=linked), width, linked) == messages
    with pytest.raises(block.BlockError):
        block.unpack_messages(block.pack_messages(messages)[:-1])


def test_zero_runs():
    assert block.zero_runs(b"a" + bytes(10) + b"b" + bytes(3)) == [(1, 10)]
    assert block.zero_runs(b"") == []


OPTIONS = [frames.Options(b, i, bc, cc, cs, d) for b in (4, 7) for i in (True, False) for bc in (True, False) for cc in (True, False) for cs, d in ((True, None), (False, 9))]


@pytest.mark.parametrize("options", OPTIONS)
def test_frames_round_trip(options):
    for raw in (b"", b"x", generators.noise(150_000, 1, 0.7)):
        data = frames.encode(raw, options)
        (frame,) = frames.frames(data)
        assert frame.payload == raw and frame.end == len(data) and frame.content_size == (len(raw) if options.content_size else None) and frame.dict_id == options.dict_id
        assert (frame.block_checksum, frame.content_checksum) == (options.block_checksum, options.content_checksum)
        assert frame.block_id == frames.fitting_id(len(raw), options.block_id)


def test_the_empty_frame_is_fixed():
    assert frames.encode(b"", frames.Options(4, True, False, False, False)).hex() == "04224d18604082" + "00000000"


def test_linked_blocks_and_dictionaries():
    raw = generators.words(200_000, 3).encode()
    linked, alone = (frames.encode(raw, frames.Options(4, i)) for i in (False, True))
    assert frames.decode(linked) == raw and len(linked) < len(alone)
    words = raw[:60_000]
    packed = frames.encode(raw[60_000:61_000], dictionary=words)
    assert frames.decode(packed, words) == raw[60_000:61_000]
    assert frames.test(packed) is not None


def test_files_of_many_frames():
    a, b = b"first " * 50, b"second " * 50
    data = frames.encode(a) + frames.skippable(b"aside", 15) + frames.encode(b"") + frames.legacy(b) + frames.encode(a)
    assert frames.decode(data) == a + b + a
    assert [f.kind for f in frames.frames(data, decode=False)] == ["standard", "skippable", "standard", "legacy", "standard"]
    assert frames.decode(frames.legacy(b)) == b and frames.decode(b"") == b""
    with pytest.raises(frames.FrameError, match="skippable_number_invalid"):
        frames.skippable(b"", 16)


def test_sized_containers():
    raw = generators.noise(10_000, 1, 0.5)
    data = frames.sized_container(raw, 3000)
    size, blocks = frames.read_sized_container(data)
    assert size == 3000 and len(blocks) == 4 and blocks[0][0] == 12 + 16 and frames.decode_sized_container(data) == raw
    with pytest.raises(frames.FrameError, match="empty_input"):
        frames.sized_container(b"")
    with pytest.raises(frames.FrameError, match="truncated"):
        frames.read_sized_container(data[:-1])


def test_an_empty_stored_block_goes_on():
    data = frames.encode(b"hello")
    at = next(frames.frames(data, decode=False)).header_size
    assert frames.decode(data[:at] + (0x80000000).to_bytes(4, "little") + data[at:]) == b"hello"


def _with(data, at, value):
    return data[:at] + bytes([value]) + data[at + 1 :]


def test_errors_have_codes():
    data = frames.encode(b"some text " * 20, frames.Options(4, True, True, True, True))
    head = next(frames.frames(data, decode=False)).header_size
    cases = {
        "unknown_format": b"plain", "trailing_garbage": data + b"garbage", "truncated": data[:-1], "version_wrong": _with(data, 4, data[4] & 0x3F | 0x80),
        "reserved_flag_set": _with(data, 4, data[4] | 2), "block_size_invalid": _with(data, 5, 0x10), "header_checksum_invalid": _with(data, head - 1, data[head - 1] ^ 1),
        "block_checksum_invalid": _with(data, head + 6, data[head + 6] ^ 1), "content_checksum_invalid": _with(data, len(data) - 1, data[-1] ^ 1),
        "block_too_large": data[:head] + (0x7FFFFFF).to_bytes(4, "little") + data[head + 4 :],
    }
    for code, bad in cases.items():
        assert frames.test(bad) == code
    assert frames.test(data) is None
    assert frames.decode(b"plain", pass_through=True) == b"plain"
    assert frames.decode(data + b"garbage", ignore_garbage=True) == b"some text " * 20
    assert frames.decode(_with(data, len(data) - 1, data[-1] ^ 1), verify=False) == b"some text " * 20
    wrong = bytearray(frames.encode(b"abc", frames.Options(4, True, False, False, True)))
    wrong[6] = 9
    wrong[14] = hashing.xxh32(bytes(wrong[4:14])) >> 8 & 0xFF
    assert frames.test(bytes(wrong)) == "content_size_wrong"


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=60), st.integers(0, 200))
def test_noise_in_frames_fails_only_as_frame_error(noise, at):
    data = frames.encode(b"hello world " * 20, frames.Options(4, True, True, True, True))
    bad = data[: min(at, len(data))] + noise
    try:
        for _ in frames.frames(bad):
            pass
    except frames.FrameError:
        pass


def test_hashes():
    assert hashing.xxh32(b"") == 0x02CC5D05
    assert hashing.xxh64(b"") == 0xEF46DB3751D8E999
    assert hashing.signed(hashing.xxh64(b"abc", 42)) == 1423657621850124518
    data = os.urandom(1000)
    for bits, whole in ((32, hashing.xxh32(data, 7)), (64, hashing.xxh64(data, 7))):
        assert hashing.fold([data[:3], b"", data[3:700], data[700:]], bits, 7) == whole
        assert hashing.from_canonical(hashing.canonical(whole, bits)) == whole


def test_generators_are_seeded():
    assert generators.noise(5000, 1) == generators.noise(5000, 1) != generators.noise(5000, 2)
    assert len(block.encode(generators.noise(50_000, 1, 0.9))) < len(block.encode(generators.noise(50_000, 1, 0.1)))
    assert len(block.encode(generators.noise(200_000, 1, 1.0))) < 2000
    assert generators.words(1000, 1) == generators.words(1000, 1) and len(generators.words(1000, 1)) == 1000


@pytest.mark.parametrize("level", [1, 9, 12])
def test_favouring_decoding_speed(level):
    raw = generators.words(20_000, 5).encode() + b"ab" * 500
    packed = block.encode(raw, level=level, favor_decode=True)
    assert block.decode(packed) == raw
    found = block.sequences(packed)[:-1]
    assert all(s.offset >= 8 and not 19 <= s.match_len <= 36 for s in found)


def test_stored_frames():
    raw = b"zero " * 1000
    data = frames.encode(raw, frames.Options(4, store=True, content_checksum=False))
    assert len(data) == 7 + 4 + len(raw) + 4 and frames.decode(data) == raw
    assert [b[2] for b in next(frames.frames(data)).blocks] == [True]


@pytest.mark.parametrize("level", [-8, 0, 1, 2, 3, 4, 9, 10, 12])
def test_blocks_of_a_batch(level):
    """Many cells at once: any decoder reads them, and the lower levels' blocks are those of single cells."""
    from tessera.kernels import batch

    cells = [*EDGES[:20], b"x" * 70_000, b"abcdefg" * 9000, generators.noise(4000, 1, 0.7)] + [generators.words(n, n).encode() for n in range(10, 1500, 197)]
    for dictionary in (b"", b"ab", generators.words(70_000, 3).encode()):
        packed = batch.encode_many(cells, level=level, dictionary=dictionary)
        assert [block.decode(p, len(c), dictionary) for p, c in zip(packed, cells)] == cells
        assert batch.decode_many(packed, dictionary=dictionary) == cells
        for p, c in zip(packed, cells):
            assert len(p) <= block.compress_bound(len(c)) and sum(len(s.literals) + (s.match_len or 0) for s in block.sequences(p)) == len(c)
    few = cells[-4:]
    packed, single = batch.encode_many(few, level=level), [block.encode(c, level=level) for c in few]
    assert packed == single if level < 3 else sum(map(len, packed)) <= 1.005 * sum(map(len, single))


def test_damaged_blocks_of_a_batch():
    from tessera.kernels import batch

    cells = [generators.words(900, k).encode() for k in (1, 2)]
    packed, found = batch.encode_many(cells), []
    damaged = [packed[0], b"\x10a\0\0", packed[1], b""]
    assert batch.decode_many(damaged, failed=found.append) == [cells[0], None, cells[1], None] and len(found) == 2
    with pytest.raises(block.BlockError):
        batch.decode_many(damaged)


@pytest.mark.parametrize(("level", "seconds"), [(4, 5), (9, 6), (12, 20)])
def test_high_levels_take_bounded_time(level, seconds):
    """Half of what a megabyte of the documents took cell by cell at most."""
    import time

    import pyarrow.parquet as pq

    from tessera.kernels import batch

    column = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()
    texts, began = [(t or "").encode() for t in column[:300]], time.process_time()
    batch.encode_many(texts, level=level)
    assert time.process_time() - began < seconds / 2 * sum(map(len, texts)) / 1e6


def test_frames_of_a_batch():
    """Blocks of many linked frames packed together decode frame by frame, and an indexed history isn't searched anew for each block."""
    import time

    cells = [generators.words(n, n).encode() for n in (0, 5, 900, 1000, 1001, 4000)] + [b"ab" * 3000, b"", os.urandom(2500)]
    options = frames.Options(independent=False, block_size=1000, block_checksum=True, content_size=True)
    for words in (b"", generators.words(3000, 8).encode()):
        packed = frames.encode_many(cells, options, words)
        assert [frames.decode(p, words) for p in packed] == cells
    long = b"".join(generators.words(2000, k).encode() for k in range(60))
    began = time.process_time()
    assert frames.decode(frames.encode(long, frames.Options(independent=False, block_size=1000))) == long
    assert len(frames.encode(bytes(3 << 20), frames.Options(7))) < 20_000
    packed = frames.encode_blocks(long, frames.Options(block_size=500))
    assert time.process_time() - began < 5 and len(packed) < len(long)


def test_a_dictionary_is_indexed_once_for_many_streams():
    import time

    from tessera.kernels import batch

    words = generators.words(65536, 1).encode()
    messages = [words[k * 90 + 5000 : k * 90 + 5400] + b"%d" % k for k in range(600)]
    fresh, began = [k % 3 == 0 for k in range(600)], time.process_time()
    packed = batch.encode_streams(messages, fresh, level=2, dictionary=words)
    assert batch.decode_streams(packed, fresh, words) == messages
    assert time.process_time() - began < 4  # message by message it took some 20 ms each
    history = b""
    for p, m, new in zip(packed, messages, fresh):
        history = words if new else history
        assert block.decode(p, history=history[-65536:]) == m and len(p) < 60
        history += m
    again = batch.encode_streams(messages[100:], fresh[100:], level=2, dictionary=words, before=messages[99])
    assert not fresh[100] and block.decode(again[0], history=(words + messages[99])[-65536:]) == messages[100]
