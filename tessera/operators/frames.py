"""Files of frames: metadata, integrity, pass-through and writing."""

from __future__ import annotations

from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.kernels import frames

#: Names that listings give to the kinds of frames.
KIND_NAMES = {"standard": "StandardFrame", "legacy": "LegacyFrame", "skippable": "SkippableFrame"}

ROWS = "path string, file_size long, frame_no int, kind string, block string, checksum string, frame_size long, content_size long, blocks int, error string"


def list_frames(files: DataFrame, path: str = "path", content: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each frame of each file, from headers and block words only, with the file's columns to keep.

    frame_size counts all of a frame's bytes, its header and checksums among them. content_size is null where the header
    has none, or 0. A damaged file's last row has its error and no kind. Null contents have no rows.
    """

    def run(batches):
        for batch in batches:
            out = []
            for name, data, *kept in batch.itertuples(index=False, name=None):
                if data is None:
                    continue
                data, n = bytes(data), 0
                try:
                    for f in frames.frames(data, decode=False):
                        out.append((name, len(data), n, f.kind, f.label, f.checksum, f.end - f.start, f.content_size or None, len(f.blocks), None, *kept))
                        n += 1
                except frames.FrameError as e:
                    out.append((name, len(data), n, None, None, None, None, None, None, e.code, *kept))
            yield pd.DataFrame(out, columns=[*(c.split()[0] for c in ROWS.split(", ")), *keep]).astype({"content_size": "Int64", "frame_size": "Int64", "blocks": "Int32", "frame_no": "int32"})

    kinds = dict(files.dtypes)
    rows = files.select(F.col(path).cast("string").alias("path"), F.col(content).cast("binary").alias("content"), *keep)
    return rows.mapInPandas(run, ROWS + "".join(f", `{k}` {kinds[k]}" for k in keep))


def list_files(listed: DataFrame) -> DataFrame:
    """A row for each file of list_frames: frames, type and block ('-' where they are mixed), compressed, uncompressed, ratio.

    uncompressed and ratio are null unless every frame carries its content size.
    """
    same_kind = F.min("kind") == F.max("kind")  # one pass and one shuffle, where distinct counts take two
    same_block = (F.min("block") == F.max("block")) & F.bool_and(F.col("kind") == "standard")
    name = F.min("kind")
    label = F.when(name == "standard", KIND_NAMES["standard"]).when(name == "legacy", KIND_NAMES["legacy"]).otherwise(KIND_NAMES["skippable"])
    whole = F.count_if(F.col("content_size").isNull()) == 0
    grouped = listed.groupBy("path").agg(
        F.count("kind").cast("long").alias("frames"),
        F.when(same_kind, label).otherwise("-").alias("type"),
        F.when(same_block, F.min("block")).otherwise("-").alias("block"),
        F.max("file_size").alias("compressed"),
        F.when(whole, F.sum("content_size")).alias("uncompressed"),
        F.max("error").alias("error"),
    )
    return grouped.withColumn("ratio_pct", F.when(F.col("uncompressed") > 0, 100.0 * F.col("compressed") / F.col("uncompressed")))


def test_files(files: DataFrame, path: str = "path", content: str = "content", dictionary: bytes = b"") -> DataFrame:
    """path, ok and error of each file: decoded and checked, the bytes thrown away."""
    from tessera.functions.codec import frame_error

    found = files.select(F.col(path).alias("path"), frame_error(F.col(content), dictionary).alias("error"))
    return found.select("path", F.col("error").isNull().alias("ok"), "error")


def write_files(df: DataFrame, key: str, data: str, options: frames.Options = frames.Options(), chunk: int = 4 << 20) -> DataFrame:
    """One frame for each row: key, content, packed in parallel chunk by chunk and joined in order.

    Chunks of a linked frame get the 64 KB before them as raw history, so that they are packed in parallel too. Null data have no frame.
    """
    own = replace(options, block_id=frames.fitting_id(options.cut)) if options.block_size else options
    chunk = max(own.cut, chunk // own.cut * own.cut)

    def run(batches):
        for batch in batches:
            packed = [frames.encode_blocks(bytes(raw), own, bytes(tail)) for raw, tail in zip(batch["raw"], batch["tail"])]
            yield pd.DataFrame({"own_key": batch["own_key"], "block_no": batch["block_no"], "packed": packed})

    raw = F.col(data).cast("binary")
    last = F.greatest(F.ceil(F.octet_length(raw) / F.lit(chunk)) - 1, F.lit(0)).cast("int")
    each = df.where(F.col(data).isNotNull()).select(F.col(key).alias("own_key"), raw.alias("whole"), F.explode(F.sequence(F.lit(0), last)).alias("block_no"))
    at = F.col("block_no") * chunk
    tail = F.substring("whole", F.greatest(at - 65536, F.lit(0)) + 1, F.least(at, F.lit(65536)))
    pieces = each.select("own_key", "block_no", F.substring("whole", at + 1, F.lit(chunk)).alias("raw"), (F.lit(b"") if own.independent else tail).alias("tail"))
    kind = dict(df.dtypes)[key]
    packed = pieces.repartition("own_key", "block_no").mapInPandas(run, f"own_key {kind}, block_no int, packed binary")
    joined = packed.groupBy("own_key").agg(F.expr("listagg(packed, X'') WITHIN GROUP (ORDER BY block_no)").alias("body"))
    ends = df.where(F.col(data).isNotNull()).select(F.col(key).alias("own_key"), raw.alias("whole"))

    @F.pandas_udf("struct<head: binary, tail: binary>")
    def edges(whole: pd.Series) -> pd.DataFrame:
        rows = [(frames.header(own, len(w) if own.content_size else None), frames.ending(bytes(w), own)) for w in whole]
        return pd.DataFrame(rows, columns=["head", "tail"])

    both = joined.join(ends.select("own_key", edges("whole").alias("edge")), "own_key")
    return both.select(F.col("own_key").alias(key), F.concat("edge.head", "body", "edge.tail").alias("content"))
