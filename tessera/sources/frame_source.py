"""`spark.read.format("tessera_frames")`: frame files as rows, and a writer of frame files.

Reading, a file is a partition, read by ranges. A row is a frame, or with option `rows` = "blocks" a block: then `frame_no` and `block_no`
number rows, and a task holds one block and the 64 KB before it, however large a frame is. With option `payload` = false only
headers and block words are read. Writing, each task makes files of one frame each from its rows' `data`, block by block; a file takes rows until it
has `fileBytes` of data (16 MB unless told), so that who reads it whole holds no more. With option `contentSize` = true, which the header needs before the
first block, the writer holds a file's data.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tessera.kernels import frames

#: Bytes of data in a written file, and of rows that a reader hands on at once; one row may be larger.
FILE_BYTES, READ_BYTES = 16 << 20, 4 << 20


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_frames"

    def schema(self) -> str:
        by_block = self.options.get("rows", "frames").lower() == "blocks"
        return "path string, frame_no int, kind string, content_size long, data binary" + (", block_no int" if by_block else "")

    def reader(self, schema) -> "FrameReader":
        return FrameReader(self.options)

    def writer(self, schema, overwrite: bool) -> "FrameWriter":
        return FrameWriter(self.options, overwrite, [f.name for f in schema.fields])


@dataclass
class FilePartition(InputPartition):
    path: str

    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class FrameReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.by_block = options.get("rows", "frames").lower() == "blocks"
        self.payload = options.get("payload", "true").lower() != "false"
        self.verify = options.get("skipchecksums", options.get("skipChecksums", "false")).lower() != "true"

    def partitions(self):
        from pyarrow import fs

        system, place = _fs(self.path)
        info = system.get_file_info(place)
        if info.type == fs.FileType.File:
            return [FilePartition(place)]
        found = system.get_file_info(fs.FileSelector(place, recursive=True))
        return [FilePartition(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]

    def read(self, partition):
        system, _ = _fs(self.path)
        with system.open_input_file(partition.path) as source:
            view = frames.View(lambda at, n: source.read_at(n, at), source.size())
            yield from self._batches(self._blocks(partition.path, view) if self.by_block else self._frames(partition.path, view))

    def _frames(self, path: str, view):
        for n, f in enumerate(frames.frames(view, decode=self.payload, verify=self.verify)):
            yield path, n, f.kind, f.content_size, f.payload

    def _blocks(self, path: str, view):
        frame_no = block_no = 0
        for f, data in frames.blocks(view, decode=self.payload, verify=self.verify):
            if data is None:
                frame_no, block_no = frame_no + 1, 0
            else:
                yield path, frame_no, f.kind, f.content_size, data if self.payload else None, block_no
                block_no += 1

    def _batches(self, rows):
        """Rows as record batches of so many bytes: Spark would gather them by number, whatever their size."""
        import pyarrow as pa

        kinds = [("path", pa.string()), ("frame_no", pa.int32()), ("kind", pa.string()), ("content_size", pa.int64()), ("data", pa.binary())]
        schema = pa.schema(kinds + [("block_no", pa.int32())] if self.by_block else kinds)

        def made(held):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

        held, size = [], 0
        for row in rows:
            held.append(row)
            size += 100 + len(row[4] or b"")
            if size >= READ_BYTES:
                yield made(held)
                held, size = [], 0
        if held:
            yield made(held)


@dataclass
class Written(WriterCommitMessage):
    drafts: list[str]


class FrameWriter(DataSourceWriter):
    """Tasks write drafts; commit renames them, abort deletes them, so a failed job leaves nothing."""

    def __init__(self, options, overwrite: bool, columns: list[str]):
        self.path, self.overwrite = options["path"], overwrite
        self.data = columns.index("data")
        given = {k.lower(): v for k, v in options.items()}
        self.sized = given.get("contentsize", "false").lower() == "true"
        self.most = int(given.get("filebytes", FILE_BYTES))
        size = int(given["blocksize"]) if "blocksize" in given else None
        self.options = frames.Options(content_size=self.sized, level=int(given.get("level", "0")), independent=given.get("independent", "true").lower() == "true", block_size=size)

    def write(self, iterator):
        import uuid

        rows, drafts = (bytes(row[self.data]) for row in iterator if row[self.data]), []
        system, place = _fs(self.path)
        for first in rows:
            if not drafts:
                system.create_dir(place, recursive=True)
            drafts.append(f"{place}/.draft-{uuid.uuid4().hex}")
            part = self._part(first, rows)
            whole = b"".join(part) if self.sized else None
            writer = frames.FrameWriter(system.open_output_stream(drafts[-1]), self.options, len(whole) if self.sized else None)
            for data in [whole] if self.sized else part:
                writer.add(data)
            writer.close()
        return Written(drafts)

    def _part(self, first: bytes, rows):
        """The data of a file: the first row's, and more until there are enough bytes."""
        yield first
        size = len(first)
        while size < self.most and (data := next(rows, None)) is not None:
            size += len(data)
            yield data

    def commit(self, messages):
        from pyarrow import fs

        system, place = _fs(self.path)
        system.create_dir(place, recursive=True)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(place)):
                if f.type == fs.FileType.File and not f.base_name.startswith("."):
                    system.delete_file(f.path)
        for m in messages:
            for draft in m.drafts if m else ():
                system.move(draft, draft.replace("/.draft-", "/part-"))

    def abort(self, messages):
        system, _ = _fs(self.path)
        for m in messages:
            for draft in m.drafts if m else ():
                system.delete_file(draft)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FrameSource)
