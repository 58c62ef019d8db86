"""Web archives in ZIP packages: record files stored as members beside their indexes, read by ranges.

A reader finds members by the central directory, or its ZIP64 form. Record files (`*.warc.gz`, with a gzip member a
record, or `*.warc`) and indexes (`*.cdxj`, `*.cdx`, either with `.gz`) may lie anywhere in a package; an index names the
file, offset and length of each record, and records are read by ranges, without extraction. A record file that no
index names is walked from record to record. The writer makes `archive/data-N.warc.gz` and `indexes/data-N.cdxj`.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import struct
import uuid
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, files_at, in_batches, partitions, sieved, small_batches, text_of, work_folder, written

MEMBER_BYTES = 16 << 20
#: Bytes read at once, stretch of a record file that goes to one task, and bytes of record files for a task.
RUN_BYTES, STRETCH, TASK_BYTES = 4 << 20, 16 << 20, 64 << 20
MOST32, MOST16 = 0xFFFFFFFF, 0xFFFF

LOCAL = struct.Struct("<4s5H3I2H")
CENTRAL = struct.Struct("<4s6H3I5H2I")
END = struct.Struct("<4s4H2IH")
#: The fields of index lines that have no header, by their number. V is the offset, S the length, g the file.
CDX_FIELDS = {9: "NbamskrVg", 10: "NbamskrMVg", 11: "NbamskrMSVg"}
END64 = struct.Struct("<4sQ2H2I4Q")
LOCATOR = struct.Struct("<4sIQI")


class ZipWriter:
    """Writes stored members. ZIP64 fields appear where a number needs them, or always (zip64=True)."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.zip64, self.at, self.members = out, zip64, 0, []

    def add(self, name: str, data: bytes) -> int:
        """Writes a member; the position of its data."""
        raw, crc = name.encode("utf-8"), zlib.crc32(data)
        wide = self.zip64 or len(data) >= MOST32
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if wide else b""
        size = MOST32 if wide else len(data)
        head = LOCAL.pack(b"PK\3\4", 45 if wide else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra)) + raw + extra
        self.members.append((raw, crc, len(data), self.at))
        self.out.write(head)
        self.out.write(data)
        self.at += len(head) + len(data)
        return self.at - len(data)

    def close(self) -> None:
        start = self.at
        for raw, crc, size, at in self.members:
            fields = [n for n in (size, size, at) if self.zip64 or n >= MOST32]
            extra = struct.pack(f"<HH{len(fields)}Q", 1, 8 * len(fields), *fields) if fields else b""
            short = [MOST32 if self.zip64 or n >= MOST32 else n for n in (size, at)]
            entry = CENTRAL.pack(b"PK\1\2", 45, 45 if fields else 20, 0x800, 0, 0, 0x21, crc, short[0], short[0], len(raw), len(extra), 0, 0, 0, 0, short[1]) + raw + extra
            self.out.write(entry)
            self.at += len(entry)
        n, size = len(self.members), self.at - start
        if self.zip64 or n >= MOST16 or size >= MOST32 or start >= MOST32:
            self.out.write(END64.pack(b"PK\6\6", END64.size - 12, 45, 45, 0, 0, n, n, size, start) + LOCATOR.pack(b"PK\6\7", 0, self.at, 1))
        end = [MOST16 if self.zip64 else min(n, MOST16), MOST32 if self.zip64 else min(size, MOST32), MOST32 if self.zip64 else min(start, MOST32)]
        self.out.write(END.pack(b"PK\5\6", 0, 0, end[0], end[0], end[1], end[2], 0))
        self.out.close()


def zip_members(source) -> list[dict]:
    """Members of a package by its directory: name, method, crc, size, packed, header (position of its local header).

    source has size() and read_at(bytes, position). Reads the end, and the directory.
    """
    whole = source.size()
    tail_at = max(0, whole - END.size - MOST16)
    tail = source.read_at(whole - tail_at, tail_at)
    at = tail.rfind(b"PK\5\6")
    while at >= 0 and (at + END.size > len(tail) or at + END.size + END.unpack_from(tail, at)[7] != len(tail)):
        at = tail.rfind(b"PK\5\6", 0, at)
    if at < 0:
        raise ValueError("no end of a central directory")
    _, _, _, _, n, size, start, _ = END.unpack_from(tail, at)
    if MOST16 == n or MOST32 in (size, start):
        place = tail_at + at - LOCATOR.size
        sign, _, far, _ = LOCATOR.unpack(source.read_at(LOCATOR.size, place)) if place >= 0 else (b"", 0, 0, 0)
        if sign == b"PK\6\7":
            sign, *_, n, size, start = END64.unpack(source.read_at(END64.size, far))
            if sign != b"PK\6\6":
                raise ValueError("no ZIP64 end where its locator points")
    data, at, found = source.read_at(size, start), 0, []
    for _ in range(n):
        sign, _, _, _, method, _, _, crc, packed, own, name_n, extra_n, note_n, _, _, _, head = CENTRAL.unpack_from(data, at)
        if sign != b"PK\1\2":
            raise ValueError("a damaged central directory")
        name = data[at + CENTRAL.size : at + CENTRAL.size + name_n].decode("utf-8")
        extra = data[at + CENTRAL.size + name_n : at + CENTRAL.size + name_n + extra_n]
        while len(extra) >= 4:
            kind, length = struct.unpack_from("<HH", extra)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, 4))
                own, packed, head = (next(wide) if x == MOST32 else x for x in (own, packed, head))
            extra = extra[4 + length :]
        found.append({"name": name, "method": method, "crc": crc, "size": own, "packed": packed, "header": head})
        at += CENTRAL.size + name_n + extra_n + note_n
    return found


def data_start(source, member: dict) -> int:
    """Where a stored member's data begin; its local header has a name and extra field of its own."""
    if member["method"]:
        raise ValueError(f"{member['name']} is compressed, so no range of it can be read")
    sign, *_, name_n, extra_n = LOCAL.unpack(source.read_at(LOCAL.size, member["header"]))
    if sign != b"PK\3\4":
        raise ValueError(f"no local header of {member['name']}")
    return member["header"] + LOCAL.size + name_n + extra_n


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or without its payload a revisit record, as WARC/1.1."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    own = f"page:{page}" if page is not None else f"uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {digest}')}"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:{own}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {' '.join(url.split())}"] if url else []
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode("utf-8") + block + b"\r\n\r\n"


def _head(raw: bytes) -> tuple[dict, int, int]:
    """(fields with lower-case names, where the block begins, its length) of the record that raw begins with."""
    at = raw.find(b"\r\n\r\n")
    lines = raw[: max(at, 0)].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    if not fields.get("content-length", "").isdigit():
        raise ValueError("a WARC record without its length")
    return fields, at + 4, int(fields["content-length"])


def parse_record(raw: bytes) -> dict:
    """Fields of a record (lower-case names), the header of its HTTP message if it is one, and its payload."""
    fields, at, size = _head(raw)
    block = raw[at : at + size]
    if len(block) < size:
        raise ValueError("a WARC record shorter than its length")
    if not fields.get("content-type", "").startswith("application/http"):
        return {"fields": fields, "http": b"", "payload": block}
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"fields": fields, "http": http, "payload": payload}


def _http_field(http: bytes, name: bytes) -> bytes | None:
    return next((x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(name + b":")), None)


def _page(urn: str | None) -> int | None:
    own = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(own) if own.removeprefix("-").isdigit() else None


def inflated(chunks):
    """The bytes of a file of gzip members."""
    one = zlib.decompressobj(31)
    for chunk in chunks:
        while chunk:
            yield one.decompress(chunk)
            chunk, one = (one.unused_data, zlib.decompressobj(31)) if one.eof else (b"", one)


def index_entries(chunks):
    """(record file's base name or None, offset, length or None) of each line of an index, CDXJ or CDX with or without header."""
    held, fields = b"", None

    def entry(line: str):
        if "{" in line:
            own = json.loads(line[line.index("{") :])
            name, offset, length = (own.get(k) for k in ("filename", "offset", "length"))
        else:
            parts = line.split()
            own = dict(zip(fields or CDX_FIELDS.get(len(parts), ""), parts))
            name, offset, length = (own.get(k) for k in "gVS")
        if offset in (None, "-"):
            raise ValueError(f"an index line without an offset: {line[:80]}")
        return (name.rsplit("/", 1)[-1] if name else None), int(offset), None if length in (None, "-") else int(length)

    for chunk in itertools.chain(chunks, [b"\n"]):
        *lines, held = (held + chunk).split(b"\n")
        for line in lines:
            line = line.decode("utf-8").strip()
            if line.startswith("CDX "):
                fields = line.split()[1:]
            elif line and not line.startswith("!"):
                yield entry(line)


def read_chunks(source, start: int, size: int, at: int = 0):
    while at < size:
        chunk = source.read_at(min(RUN_BYTES, size - at), start + at)
        if not chunk:
            raise ValueError("a member runs past the package's end")
        yield chunk
        at += len(chunk)


def walk(chunks, zipped: bool, at: int = 0):
    """(offset, record) one after another from chunks of a record file, the first at offset `at`; offsets are those of gzip members.

    Holds one record, or one gzip member where it has several.
    """
    if zipped:
        one, out, end = zlib.decompressobj(31), [], at
        for chunk in chunks:
            end += len(chunk)
            while chunk:
                out.append(one.decompress(chunk))
                if not one.eof:
                    break
                chunk = one.unused_data
                for _, raw in walk([b"".join(out)], False):
                    yield at, raw
                one, out, at = zlib.decompressobj(31), [], end - len(chunk)
        if any(out):
            raise ValueError("a truncated gzip member")
        return
    held = b""
    for chunk in chunks:
        held += chunk
        while b"\r\n\r\n" in held:
            _, first, size = _head(held)
            if len(held) < first + size + 4:
                break
            yield at, held[: first + size]
            held, at = held[first + size + 4 :], at + first + size + 4
    if held.strip():
        raise ValueError("a truncated record")


def write_archives(df: DataFrame, folder: str, *, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", least_bytes: int = 0, zip64: bool = True) -> DataFrame:
    """Writes a record for each row into packages below `folder`; returns the table of packages (path, members, records).

    Of rows with equal payloads of at least `least_bytes` bytes, the one with the largest id is a response and
    the others revisit it; smaller payloads are all responses. Null payload counts as empty. A null id is the
    smallest, and refers to a response only if the group has an id; rows that repeat the largest id are all
    responses. A null url is left out. Other columns are ignored; an empty table gives no package.

    Groups of equal payloads are pre-aggregated by digest. They are sent to every task if they are few, counted rows, so
    that payloads stay where they are; else only payloads that a map of the groups' digests lets pass are shuffled, in
    a join that Spark splits where a digest is hot. A task holds one member.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), F.encode(text_of(payload_column), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    groups = rows.where(F.octet_length("payload") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").select("sha1", "response")
    groups = written(groups, f"{folder}/groups")
    n = groups.count()
    if n <= BROADCAST_ROWS:
        named = rows.join(F.broadcast(groups), "sha1", "left")
    else:
        told = sieved(rows, "sha1", groups.select("sha1"), n)
        lone = told.where("not maybe").drop("maybe").withColumn("response", F.lit(None).cast("long"))
        named = lone.unionByName(told.where("maybe").drop("maybe").join(groups.hint("merge"), "sha1", "left"))
    marked = named.select("page_id", "url", "payload", "sha1", F.when(F.col("page_id").eqNullSafe(F.col("response")), None).otherwise(F.col("response")).alias("refers_to"))

    def write(batches):
        import pyarrow as pa

        package, members, records, data, index, at = None, 0, 0, [], [], 0
        system, place = files_at(folder)
        name = f"pages-{uuid.uuid4().hex}.wacz"

        def flush():
            nonlocal members, data, index, at
            package.add(f"archive/data-{members}.warc.gz", b"".join(data))
            package.add(f"indexes/data-{members}.cdxj", "".join(index).encode("utf-8"))
            members, data, index, at = members + 1, [], [], 0

        for batch in batches:
            for k in range(batch.num_rows):
                page, url, payload, sha1, refers_to = (batch.column(c)[k].as_py() for c in range(5))
                if package is None:
                    system.create_dir(f"{place}/packages", recursive=True)
                    package = ZipWriter(system.open_output_stream(f"{place}/packages/{name}"), zip64)
                pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                raw = pack.compress(record(page, url, payload, base64.b32encode(bytes.fromhex(sha1)).decode(), refers_to)) + pack.flush()
                index.append(f"{'' if page is None else page} {json.dumps({'filename': f'data-{members}.warc.gz', 'offset': at, 'length': len(raw)})}\n")
                data.append(raw)
                at, records = at + len(raw), records + 1
                if at >= MEMBER_BYTES:
                    flush()
        if package is not None:
            if data:
                flush()
            package.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/packages/{name}"], "members": pa.array([members], pa.int64()), "records": pa.array([records], pa.int64())})

    return written(marked.mapInArrow(write, "path string, members long, records long"), f"{folder}/manifest")


MEMBERS = "path string, name string, method int, crc long, size long, start long, error string"


def read_members(packages: DataFrame, strict: bool = True) -> DataFrame:
    """Every member of packages (column path) by their directories: path, name, method, crc, size, start (of its data), error.

    A compressed member has no start, as no range of it can be read. A package that can't be read is an error, with
    strict=False a row with nothing but its path and the error. No packages give no rows; a null path is none.
    """

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("path", pa.string()), ("name", pa.string()), ("method", pa.int32()), ("crc", pa.int64()), ("size", pa.int64()), ("start", pa.int64()), ("error", pa.string())])

        def rows():
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    try:
                        system, place = files_at(path)
                        with system.open_input_file(place) as source:
                            for m in zip_members(source):
                                yield path, m["name"], m["method"], m["crc"], m["size"], data_start(source, m) if not m["method"] else None, None
                    except (ValueError, struct.error) as e:
                        if strict:
                            raise ValueError(f"{path}: {e}") from e
                        yield path, None, None, None, None, None, str(e)

        yield from in_batches(rows(), schema)

    spread = packages.where("path is not null").select("path").repartition(partitions(packages.sparkSession))
    return spread.mapInArrow(run, MEMBERS)


def read_index(indexes: DataFrame, strict: bool = True) -> DataFrame:
    """path, archive (base name of a record file), at and length for each line of the index members (path, name, start, size); error."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("path", pa.string()), ("archive", pa.string()), ("at", pa.int64()), ("length", pa.int64()), ("error", pa.string())])

        def rows():
            for batch in batches:
                for path, name, start, size in zip(*(batch.column(c).to_pylist() for c in range(4))):
                    own = name.rsplit("/", 1)[-1].lower().removesuffix(".gz").rsplit(".", 1)[0] + ".warc.gz"
                    system, place = files_at(path)
                    with system.open_input_file(place) as source:
                        chunks = read_chunks(source, start, size)
                        try:
                            for archive, at, length in index_entries(inflated(chunks) if name.lower().endswith(".gz") else chunks):
                                yield path, archive or own, at, length, None
                        except (ValueError, zlib.error) as e:
                            if strict:
                                raise ValueError(f"{name} in {path}: {e}") from e
                            yield path, None, None, None, f"{name}: {e}"

        yield from in_batches(rows(), schema)

    spread = indexes.select("path", "name", "start", "size").repartition(partitions(indexes.sparkSession))
    return spread.mapInArrow(run, "path string, archive string, at long, length long, error string")


RECORDS = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, "
    "record_id string, refers_to_id string, path string, archive string, at long, error string"
)


def _fields(raw: bytes) -> tuple:
    """The columns of RECORDS up to refers_to_id, and an error, of a record."""
    own = parse_record(raw)
    f, payload = own["fields"], own["payload"]
    kind, told = f.get("warc-type"), f.get("warc-payload-digest")
    error, size = None, len(payload)
    if kind == "revisit":
        digest, length = told, _http_field(own["http"], b"content-length")
        size, payload = (int(length) if length and length.isdigit() else size), None
    else:
        found = sha1_base32(payload)
        if told and told.lower().startswith("sha1:") and told[5:].upper() != found and _http_field(own["http"], b"transfer-encoding") is None:
            error = "a payload differs from its digest"
        digest = told or found
    digest = digest.split(":", 1)[1] if digest and digest.lower().startswith("sha1:") else digest
    record_id, refers = f.get("warc-record-id"), f.get("warc-refers-to")
    plain = (x.strip("<>") if x else None for x in (record_id, refers))
    return _page(record_id), f.get("warc-target-uri"), kind, _page(refers), size, digest, payload, *plain, error


def read_archives(packages: DataFrame, *, strict: bool = True, folder: str | None = None) -> DataFrame:
    """The records of packages (column path), read by ranges, as RECORDS.

    Of a record file that an index of its package names, the records that indexes name, each once; of any other, all.
    An index line names its file by `filename` or `g`; without either it is the file with the index's name. Offsets and lengths may be
    numbers or text; without a length a record ends where its gzip member does. All types of records are rows.
    page_id and refers_to are those of ids `urn:page:N`, null for other ids, which record_id and refers_to_id hold.

    payload_bytes and payload_digest are those of the full payload, of a revisit too, whose payload is null. A digest
    by SHA-1 is bare, others keep their name; it is computed from what was read and held against the record's, unless
    a transfer encoding lies between. A difference, a compressed record file or index, an index line without its file, and damaged or
    truncated files are errors: raised, or with strict=False rows with `error` and as much else as is known.

    Null paths are no packages; repeated ones are read as one. Other columns of packages don't matter. No packages give
    no rows. Lines of indexes are dealt to tasks by stretches of their files, so no file and no index is one task's; a
    task holds some megabytes, or one record.
    """
    spark = packages.sparkSession
    folder = folder or work_folder(spark, "warc-read")
    members = written(read_members(packages.select("path").distinct(), strict), f"{folder}/members")
    low = F.lower("name")
    is_file, is_index = low.rlike(r"\.warc(\.gz)?$"), low.rlike(r"\.cdxj?(\.gz)?$")
    packed = members.where((is_file | is_index) & F.col("start").isNull()).select("path", "name")
    if strict and (one := packed.first()):
        raise ValueError(f"{one['name']} in {one['path']} is compressed, so no range of it can be read")
    files = members.where(is_file & F.col("start").isNotNull()).select("path", F.substring_index("name", "/", -1).alias("archive"), "name", "start", "size")
    files = files.groupBy("path", "archive").agg(F.count("*").alias("n"), F.collect_list(F.struct("name", "start", "size")).alias("own"))
    single = files.where("n = 1").select("path", "archive", F.col("own")[0]["start"].alias("start"), F.col("own")[0]["size"].alias("size"))
    lines = written(read_index(members.where(is_index & F.col("start").isNotNull()), strict), f"{folder}/lines")
    named = lines.where("error is null").groupBy("path", "archive", "at").agg(F.max("length").alias("length"))
    several = files.where("n > 1").select("path", "archive")  # files of one name: an index can't tell them apart
    by_line = named.join(several, ["path", "archive"], "left_anti").join(single, ["path", "archive"], "left").select("path", "archive", "start", "size", "at", "length")
    alone = files.join(named.select("path", "archive").distinct(), ["path", "archive"], "left_anti").unionByName(files.where("n > 1")).dropDuplicates(["path", "archive"])
    whole = alone.select("path", F.explode("own").alias("one")).select("path", F.col("one.name").alias("archive"), F.col("one.start").alias("start"), F.col("one.size").alias("size"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("length"))
    total = members.agg(F.sum("size")).first()[0] or 0
    tasks = max(partitions(spark), -(-total // TASK_BYTES))

    def run(batches):
        import pyarrow as pa

        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in RECORDS.split(", ")])

        def records(source, unit):
            """(offset, record) of the lines, sorted by offset, of one file; all its records where it has no line."""
            (_, archive, start, size, _, _), zipped = unit[0], unit[0][1].lower().endswith(".gz")
            if start is None:
                raise ValueError(f"no record file {archive}")
            first = 0
            while first < len(unit):
                _, _, _, _, at, length = unit[first]
                if at is None:
                    yield from walk(read_chunks(source, start, size), zipped)
                    return
                if length is None:  # the record ends before the next line's, if not sooner
                    stop = unit[first + 1][4] if first + 1 < len(unit) else size
                    found = next(walk(read_chunks(source, start, min(stop, size), at), zipped, at), None)
                    if found is None:
                        raise ValueError(f"no record where an index line points in {archive}")
                    yield found
                    first += 1
                    continue
                last = first
                while last < len(unit) and unit[last][5] is not None and (last == first or unit[last][4] + unit[last][5] - at <= RUN_BYTES):
                    last += 1
                end = max(a + n for *_, a, n in unit[first:last])
                if end > size:
                    raise ValueError(f"an index line points behind the end of {archive}")
                held = source.read_at(end - at, start + at)
                for *_, a, n in unit[first:last]:
                    raw = held[a - at : a - at + n]
                    yield a, zlib.decompress(raw, 31) if zipped else raw
                first = last

        def file_rows(unit):
            path, archive = unit[0][:2]
            try:
                system, place = files_at(path)
                with system.open_input_file(place) as source:
                    for at, raw in records(source, unit):
                        *values, error = _fields(raw)
                        if error and strict:
                            raise ValueError(error)
                        yield *values, path, archive, at, error
            except (ValueError, zlib.error, struct.error) as e:
                if strict:
                    raise ValueError(f"{archive} in {path}: {e}") from e
                yield *[None] * 9, path, archive, None, str(e)

        def rows():
            unit = []
            for batch in batches:
                for line in zip(*(batch.column(c).to_pylist() for c in range(6))):
                    if unit and (unit[0][:2] != line[:2] or line[4] is None or len(unit) >= 4096):
                        yield from file_rows(unit)
                        unit = []
                    unit.append(line)
            if unit:
                yield from file_rows(unit)

        yield from in_batches(rows(), schema, weigh=lambda r: len(r[6] or b"") + 200)

    units = by_line.unionAll(whole).repartition(tasks, "path", "archive", F.floor(F.col("at") / STRETCH)).sortWithinPartitions("path", "archive", "at")
    out = units.mapInArrow(run, RECORDS)
    if strict:
        return out
    broken = members.where("error is not null").select("path", "error").unionAll(lines.where("error is not null").select("path", "error"))
    broken = broken.unionAll(packed.select("path", F.concat("name", F.lit(" is compressed, so no range of it can be read"))))
    return out.unionByName(broken, allowMissingColumns=True)


def archive(df: DataFrame, **options) -> DataFrame:
    """write_archives into a new folder, then read_archives."""
    return read_archives(write_archives(df, work_folder(df.sparkSession, "warc"), **options))
