import base64
import hashlib
import io
import struct
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import media, warc
from tessera.llm.common import work_folder


@settings(max_examples=30, deadline=None)
@given(st.binary(min_size=media.FRAME, max_size=media.FRAME), st.binary(min_size=media.FRAME, max_size=media.FRAME))
def test_frames_are_lossless(a, b):
    samples = np.frombuffer(a + b, np.uint8).reshape(2, media.SIDE, media.SIDE)
    coded = media.code_frames(samples)
    assert len(coded) == 2 * media.CODED
    assert (media.decode_frames(coded) == samples).all()
    n, frames = media.parse_avi(media.avi(1000, coded, 2))
    assert n == 1000 and b"".join(media.read_frame(f).data for f in frames) == coded


def _scalar_decode(jpeg):
    """A lossless JPEG by its own markers and Huffman table, bit by bit."""
    at, table, size = 2, {}, None
    while True:
        marker, n = struct.unpack_from(">HH", jpeg, at)
        body = jpeg[at + 4 : at + 2 + n]
        if marker == 0xFFC3:
            size = struct.unpack_from(">HH", body, 1)
        elif marker == 0xFFC4:
            code, symbols = 0, iter(body[17:])
            for length, count in enumerate(body[1:17], 1):
                for _ in range(count):
                    table[length, code] = next(symbols)
                    code += 1
                code <<= 1
        at += 2 + n
        if marker == 0xFFDA:
            break
    data = jpeg[at:-2].replace(b"\xff\x00", b"\xff")
    bits = iter("".join(f"{b:08b}" for b in data))
    out = np.zeros(size, int)
    for y in range(size[0]):
        for x in range(size[1]):
            code, length = 0, 0
            while (length, code) not in table:
                code, length = code << 1 | int(next(bits)), length + 1
            k = table[length, code]
            extra = int("".join(next(bits) for _ in range(k)) or "0", 2)
            diff = extra if not k or extra >> (k - 1) else extra - (1 << k) + 1
            out[y, x] = diff + (out[y, x - 1] if x else out[y - 1, 0] if y else 128)
    return out


def test_any_decoder_can_read_a_frame():
    samples = np.random.default_rng(3).integers(0, 256, (1, media.SIDE, media.SIDE)).astype(np.uint8)
    _, (jpeg,) = media.parse_avi(media.avi(576, media.code_frames(samples), 1))
    assert (_scalar_decode(jpeg) == samples[0]).all()


def _scalar_encode(samples, predictor, head=b""):
    """A lossless JPEG with the codes of 4 bits for categories 0 to 9, and any predictor, bit by bit."""
    bits, (h, w) = "", samples.shape
    x = samples.astype(int)
    for y in range(h):
        for k in range(w):
            a, b, c = x[y, k - 1], x[y - 1, k], x[y - 1, k - 1]
            guess = 128 if not y and not k else a if not y else b if not k else (a, b, c, a + b - c, a + ((b - c) >> 1), b + ((a - c) >> 1), (a + b) >> 1)[predictor - 1]
            d = int(x[y, k] - guess)
            n = abs(d).bit_length()
            bits += f"{n:04b}" + (f"{d if d > 0 else d + (1 << n) - 1:0{n}b}" if n else "")
    bits += "1" * (-len(bits) % 8)
    data = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    table = bytes([0, 0, 0, 10] + [0] * 12 + list(range(10)))
    return (
        b"\xff\xd8" + head + b"\xff\xc4" + struct.pack(">HB", 3 + len(table), 0) + table
        + b"\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, h, w, 1, 1, 0x11, 0) + b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, predictor, 0, 0) + data + b"\xff\xd9"
    )


@pytest.mark.parametrize("predictor", range(1, 8))
def test_frames_of_other_writers(predictor):
    samples = np.random.default_rng(predictor).integers(0, 256, (13, 7)).astype(np.uint8)
    samples[3:6] = 200
    jpeg = _scalar_encode(samples, predictor, b"\xff\xe0\0\x06JFIF\xff\xff\xfe\0\x04hi")
    frame = media.read_frame(jpeg)
    assert not frame.plain and (media.decode_frame(frame) == samples).all()
    own = np.random.default_rng(1).integers(0, 256, (2, 24, 24)).astype(np.uint8)
    plain = [media.read_frame(f) for f in media.parse_avi(media.avi(0, media.code_frames(own), 2))[1]]
    assert all(f.plain for f in plain) and (media.decode_frame(plain[1]) == own[1]).all()
    (raw, counts), (other, _) = media.decode_all([[plain[0], frame, plain[1]], [plain[1]]])
    assert raw == own[0].tobytes() + samples.tobytes() + own[1].tobytes() and other == own[1].tobytes() and counts.sum() == len(raw)


def test_frames_that_cannot_be_decoded_are_named():
    jpeg = _scalar_encode(np.zeros((8, 8), np.uint8), 1)
    at = jpeg.index(b"\xff\xc3")
    cases = {
        "another process": jpeg.replace(b"\xff\xc3", b"\xff\xc0"), "components": jpeg[: at + 9] + b"\3" + jpeg[at + 10 :], "of 12 bits": jpeg[: at + 4] + b"\x0c" + jpeg[at + 5 :],
        "restart": jpeg[:2] + b"\xff\xdd\0\4\0\2" + jpeg[2:], "without a scan": jpeg[:at], "no JPEG": b"GIF89a", "its end": jpeg[:-2], "doesn't fit": jpeg[:2] + jpeg[at:],
    }
    for reason, data in cases.items():
        with pytest.raises(ValueError, match=reason):
            media.read_frame(data)
    with pytest.raises(ValueError, match="shorter"):
        media.decode_frame(media.read_frame(jpeg[:-6] + b"\xff\xd9"))


def test_shots_by_brute_force():
    draw = np.random.default_rng(1)
    samples = np.concatenate([draw.integers(lo, lo + 40, (n, 24, 24)) for lo, n in ((0, 12), (200, 9), (90, 1), (0, 5))]).astype(np.uint8)
    assert media.shots(media.histograms(samples))[0] == 0 and 12 in media.shots(media.histograms(samples)) and 21 in media.shots(media.histograms(samples))
    counts = [np.bincount((f >> 3).reshape(-1), minlength=32) for f in samples]
    d = [int(np.abs(b - a).sum()) for a, b in zip(counts, counts[1:])]
    expected = [0]
    for k in range(len(d)):
        near = [d[i] for i in range(max(0, k - 8), min(len(d), k + 9)) if i != k]
        if d[k] * max(len(near), 1) > 2 * sum(near) + 72 * max(len(near), 1):
            expected.append(k + 1)
    assert media.shots(media.histograms(samples)) == expected


def test_media_columns(spark, odd_docs, no_docs):
    read = media.read_media(media.to_media(odd_docs))
    rows = read.collect()
    assert sorted(r["payload"][: r["n_bytes"]].decode() for r in rows) == sorted(r["text"] or "" for r in odd_docs.collect())
    assert all(len(r["payload"]) % 576 == 0 and r["payload"][r["n_bytes"] :].strip(b"\xff") == b"" and r["frames"] == len(r["payload"]) // 576 and r["error"] is None for r in rows)
    assert len({r["media_sha256"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    found = media.clips(read).groupBy("doc_id").agg({"frames": "sum", "end_s": "max"}).collect()
    frames = {}
    for r in rows:
        frames[r["doc_id"]] = frames.get(r["doc_id"], 0) + r["frames"]
    assert {r["doc_id"]: r["sum(frames)"] for r in found} == frames
    assert media.to_media(no_docs).count() == 0
    broken = spark.createDataFrame([(1, b"RIFF\0\0\0\0WAVE"), (2, None), (3, bytes(media.avi(5, media.code_frames(np.zeros((1, 24, 24), np.uint8)), 1)[:-30]))], "doc_id long, media binary")
    assert all(r["error"] and r["payload"] is None for r in media.read_media(broken).collect())
    other = [_scalar_encode(np.full((8, 8), k, np.uint8), 4) for k in (1, 200)]
    file = _avi_of(other)
    short = _avi_of([other[0], other[1][:-6] + b"\xff\xd9"])
    rows = {r["doc_id"]: r for r in media.read_media(spark.createDataFrame([(1, bytearray(file)), (2, bytearray(short)), (3, bytearray(file))], "doc_id long, media binary").coalesce(1)).collect()}
    assert rows[1]["payload"] == rows[3]["payload"] == bytes([1] * 64 + [200] * 64) and rows[1]["frames"] == 2 and "shorter" in rows[2]["error"]


def _avi_of(jpegs):
    movi = media.chunk(b"LIST", b"movi" + b"".join(media.chunk(b"00dc", j) for j in jpegs))
    return media.chunk(b"RIFF", b"AVI " + movi)


@pytest.mark.parametrize("zip64", [False, True])
def test_packages_are_zip_files(zip64):
    class Out(io.BytesIO):
        def close(self):
            pass

    out = Out()
    writer = warc.ZipWriter(out, zip64)
    starts = [writer.add(f"m{k}", bytes([k]) * k * 100) for k in range(5)]
    writer.close()
    with zipfile.ZipFile(io.BytesIO(out.getvalue())) as z:
        assert z.testzip() is None and z.read("m3") == b"\3" * 300

    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

        def read_at(self, n, at):
            return self.getvalue()[at : at + n]

    source = Source(out.getvalue())
    members = warc.zip_members(source)
    assert [m["name"] for m in members] == [f"m{k}" for k in range(5)]
    assert [warc.data_start(source, m) for m in members] == starts
    other = Source()
    with zipfile.ZipFile(other, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.txt", b"a" * 100)
        z.comment = b"a comment PK\5\6"
    (member,) = warc.zip_members(other)
    with pytest.raises(ValueError, match="compressed"):
        warc.data_start(other, member)
    with pytest.raises(ValueError):
        warc.zip_members(Source(b"nothing"))


def test_records_and_revisits(spark):
    rows = [(1, "http://a/\r\nX", "same"), (2, None, "same"), (3, "http://c", "same"), (4, "http://d", ""), (5, "http://e", None), (6, "http://f", "ü" * 9000), (None, "http://g", "lone"), (7, "http://h", "WARC/1.1\r\n\r\n"), (7, "http://h", "WARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"sha1": _lit("x"), "payload": _lit("y")})
    expected = {1: 3, 2: 3, 4: 5}
    got = warc.archive(pages).collect()
    assert len(got) == len(rows)
    texts = {r[0]: (r[2] or "").encode() for r in rows}
    for r in got:
        raw = texts[r["page_id"]]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert r["refers_to"] == expected.get(r["page_id"])
        assert r["record_type"] == ("revisit" if r["page_id"] in expected else "response")
        assert r["payload"] == (None if r["page_id"] in expected else raw)
    assert {r["record_type"] for r in warc.archive(pages, least_bytes=10**6).collect()} == {"response"}
    assert warc.archive(pages.limit(0)).count() == 0


def _lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def test_packages_read_by_ranges(spark, monkeypatch):
    pages = spark.range(200).selectExpr("id AS page_id", "concat('http://x/', id) AS url", "repeat(cast(id AS string), 50) AS html")
    packages = warc.write_archives(pages, work_folder(spark, "test-warc"))
    members = warc.read_members(packages).collect()
    assert all(m["method"] == 0 and m["start"] > 0 for m in members)
    assert {m["name"].split("/")[0] for m in members} == {"archive", "indexes"}
    assert warc.read_archives(packages).selectExpr("sum(payload_bytes)").first()[0] == sum(50 * len(str(i)) for i in range(200))


def _foreign(kind="response", payload=b"<p>hi</p>", rid="urn:uuid:6b5d0e5c-0000-4000-8000-000000000001", digest=True, http=True, extra=""):
    """A record as other writers make it."""
    block = (b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" if http else b"") + payload
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{rid}>\r\nWARC-Target-URI: http://a/\r\n{extra}"
    if digest:
        head += f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}\r\n"
    head += f"Content-Type: {'application/http; msgtype=response' if http else 'application/warc-fields'}\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _zip(place, members, method=zipfile.ZIP_STORED):
    with zipfile.ZipFile(place, "w", method) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return f"file://{place}"


def _gz(records):
    import gzip

    packed = [gzip.compress(r) for r in records]
    return b"".join(packed), [(sum(map(len, packed[:k])), len(p)) for k, p in enumerate(packed)]


def _read(spark, *paths, **options):
    return warc.read_archives(spark.createDataFrame([(p, 1) for p in paths], "path string, start int"), **options)


def test_packages_of_other_writers(spark, tmp_path):
    bodies = [b"<p>%d</p>" % k * 50 for k in range(4)]
    records = [_foreign("warcinfo", b"software: x\r\n", "urn:uuid:0", False, False)] + [_foreign(payload=b, rid=f"urn:uuid:{k + 1}") for k, b in enumerate(bodies)]
    data, places = _gz(records)
    cdx = " CDX N b a m s k r M S V g\n" + "".join(f"a,/ 2020 http://a/ text/html 200 X - - {n} {at} data.warc.gz\n" for at, n in places[1:])
    cdxj = "!meta {}\n" + "".join(f'a,/ 2020 {{"url": "http://a/", "length": "{n}", "offset": "{at}", "filename": "data.warc.gz"}}\n' for at, n in places[1:])
    no_length = "".join(f"a,/ 2020 http://a/ text/html 200 X - {at} data.warc.gz\n" for at, _ in places[1:])
    import gzip

    layouts = {
        "cdx": {"archive/data.warc.gz": data, "indexes/index.cdx": cdx, "pages/pages.jsonl": "{}"},
        "cdxgz": {"archive/data.warc.gz": data, "indexes/index.cdx.gz": gzip.compress(cdx.encode())},
        "cdxj": {"datapackage.json": "{}", "archive/data.warc.gz": data, "indexes/index.cdxj": cdxj, "indexes/more.cdx": cdx},
        "nolength": {"data.warc.gz": data, "data.cdx": no_length},
    }
    for name, members in layouts.items():
        rows = _read(spark, _zip(tmp_path / f"{name}.wacz", members)).collect()
        assert sorted(bytes(r["payload"]) for r in rows) == bodies, name
        assert sorted(r["record_id"] for r in rows) == [f"urn:uuid:{k}" for k in range(1, 5)] and {r["page_id"] for r in rows} == {None}
        assert {(r["payload_digest"], bytes(r["payload"])) for r in rows} == {(base64.b32encode(hashlib.sha1(b).digest()).decode(), b) for b in bodies}
    walked = {"gz": {"a/x.warc.gz": data}, "plain": {"x.warc": b"".join(records)}, "one": {"x.warc.gz": gzip.compress(b"".join(records))}, "two": {"a/x.warc.gz": data, "b/x.warc.gz": data}}
    for name, members in walked.items():
        rows = _read(spark, _zip(tmp_path / f"{name}.wacz", members)).collect()
        assert sorted(r["record_type"] for r in rows) == sorted((["warcinfo"] + ["response"] * 4) * len(members)), name
    twice = _zip(tmp_path / "cdx.wacz", layouts["cdx"])
    assert _read(spark, twice, twice, None).count() == 4


def test_what_cannot_be_read_is_an_error(spark, tmp_path):
    data, places = _gz([_foreign(), _foreign(payload=b"other")])
    line = '{{"filename": "{}", "offset": {}, "length": {}}}\n'
    wrong = _gz([_foreign().replace(b"<p>hi</p>", b"<p>ho</p>")])[0]
    cases = {
        "deflated": ({"archive/x.warc.gz": data}, zipfile.ZIP_DEFLATED, "compressed"),
        "lost": ({"x.cdxj": line.format("y.warc.gz", 0, 5)}, zipfile.ZIP_STORED, "no record file"),
        "far": ({"x.warc.gz": data, "x.cdxj": line.format("x.warc.gz", len(data), 50)}, zipfile.ZIP_STORED, "behind the end"),
        "inside": ({"x.warc.gz": data, "x.cdxj": line.format("x.warc.gz", 3, 50)}, zipfile.ZIP_STORED, "header"),
        "nowhere": ({"x.warc.gz": data, "x.cdxj": '{"length": 4}\n'}, zipfile.ZIP_STORED, "without an offset"),
        "behind": ({"x.warc.gz": data, "x.cdx": f"a 1 u m 200 X - {len(data)} x.warc.gz\n"}, zipfile.ZIP_STORED, "no record where"),
        "short": ({"x.warc.gz": data[:-9]}, zipfile.ZIP_STORED, "truncated"),
        "changed": ({"x.warc.gz": wrong}, zipfile.ZIP_STORED, "differs"),
    }
    paths = []
    for name, (members, method, reason) in cases.items():
        paths.append(_zip(tmp_path / f"{name}.wacz", members, method))
        with pytest.raises(Exception, match=reason):
            _read(spark, paths[-1]).collect()
    (tmp_path / "no.zip").write_bytes(b"no package")
    rows = _read(spark, *paths, f"file://{tmp_path}/no.zip", strict=False).collect()
    told = {r["path"].rsplit("/", 1)[-1].split(".")[0]: r["error"] for r in rows if r["error"]}
    assert set(told) == {*cases, "no"} and all(case[2] in told[name] for name, case in cases.items())
    assert sum(r["payload"] == b"<p>hi</p>" for r in rows) >= 1


def test_groups_beyond_the_broadcast_bound(spark, monkeypatch):
    pages = spark.range(300).selectExpr("id AS page_id", "'u' AS url", "if(id % 3 = 0, 'same', if(id % 7 = 0, concat('x', id % 2), concat('own', id))) AS html")
    columns = "page_id", "record_type", "refers_to", "payload_digest"
    want = sorted(map(str, warc.archive(pages).select(*columns).collect()))
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert sorted(map(str, warc.archive(pages).select(*columns).collect())) == want
