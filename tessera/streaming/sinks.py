"""Streams of messages packed as they arrive."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.kernels import block, frames


def frame_sink(stream: DataFrame, key: str, order: str, data: str, path: str, checkpoint: str, options: frames.Options = frames.Options(content_size=True), once: bool = False):
    """Starts a query that writes one frame for each key and micro-batch to `path`, as Parquet rows key, batch_id, content, messages.

    A batch that runs again after a failure replaces its own folder, so each message is in exactly one frame.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(F.col(key), F.col(order).alias("_at"), F.coalesce(F.col(data).cast("binary"), F.lit(b"")).alias("_data"))
        joined = rows.groupBy(key).agg(F.expr("listagg(_data, X'') WITHIN GROUP (ORDER BY _at)").alias("whole"), F.count("*").alias("messages"))

        @F.pandas_udf("binary")
        def pack(cells: pd.Series) -> pd.Series:
            return pd.Series([frames.encode(bytes(c), options) for c in cells], dtype=object)

        out = joined.select(key, pack("whole").alias("content"), "messages")
        out.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def linked_stream(stream: DataFrame, key: str, order: str, data: str, level: int = 0, dictionary: bytes = b"") -> DataFrame:
    """A stream of key, order, seq, packed and raw_size: each message packed with its key's last 64 KB as history.

    A key's state is that history, at first the dictionary, and the number of its messages, which seq counts. Messages of a micro-batch are taken in `order`; between
    batches arrival counts. blocks.unlinked_streams reads what a stream has written.
    """
    kinds = dict(stream.dtypes)

    def run(own_key, batches, state):
        history, seq = (bytes(state.get[0]), state.get[1]) if state.exists else (dictionary[-block.HISTORY :], 0)
        rows = pd.concat(list(batches)).sort_values("own_order", kind="stable")
        packed = []
        for message in rows["message"]:
            message = bytes(message)
            packed.append(block.encode(message, level=level, history=history))
            history = (history + message)[-block.HISTORY :]
        state.update((history, seq + len(packed)))
        yield pd.DataFrame({key: own_key[0], order: rows["own_order"].to_numpy(), "seq": range(seq, seq + len(packed)), "packed": packed, "raw_size": [len(m) for m in rows["message"]]})

    rows = stream.select(key, F.col(order).alias("own_order"), F.coalesce(F.col(data).cast("binary"), F.lit(b"")).alias("message"))
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {order} {kinds[order]}, seq long, packed binary, raw_size int", "history binary, seq long", "append", "NoTimeout")
