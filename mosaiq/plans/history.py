"""Edit logs: what undo and redo leave, and the state that the remaining edits make."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.session import ship_package

#: Edits of a batch that is handed back.
BATCH = 65_536


def _in_force(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, seq, action), each document's together and in order -> the edits in force."""

    def out(doc, past: array, cursor: int) -> Iterator[pa.RecordBatch]:
        for at in range(0, cursor, BATCH):
            part = past[at : min(at + BATCH, cursor)]
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(doc, pa.int64()), len(part)), pa.array(np.frombuffer(part, np.int64))], ["doc_id", "seq"])

    started, doc, past, cursor = False, None, array("q"), 0
    for batch in batches:
        for here, seq, action in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not started or here != doc:
                yield from out(doc, past, cursor)
                started, doc, past, cursor = True, here, array("q"), 0
            if action == "Undo":
                cursor = max(cursor - 1, 0)
            elif action == "Redo":
                cursor = min(cursor + 1, len(past))
            else:
                del past[cursor:]
                past.append(seq)
                cursor += 1
    yield from out(doc, past, cursor)


def effective(log: DataFrame) -> DataFrame:
    """(doc_id, seq): the edits in force after all undos and redos; both are whole numbers.

    A new edit cuts off what was undone; undo and redo move a cursor between the ends. The order
    matters, so a document's log is read in sequence: sorted on disk where it must be, and folded with
    8 bytes held for each edit that could still be redone or undone. Documents are independent.
    """
    ship_package(log.sparkSession)
    rows = log.select(F.col("doc_id").cast("long"), F.col("seq").cast("long"), "action")
    ordered = rows.repartition("doc_id").sortWithinPartitions("doc_id", "seq")
    return ordered.mapInArrow(_in_force, "doc_id long, seq long")


def replay(log: DataFrame) -> DataFrame:
    """(doc_id, layer_id, action, arg, seq): per layer and field the last value set. A partial aggregate."""
    last = log.where(~F.col("action").isin("Undo", "Redo")).groupBy("doc_id", "layer_id", "action").agg(F.max(F.struct("seq", "arg")).alias("s"))
    return last.select("doc_id", "layer_id", "action", "s.arg", "s.seq")


def state(log: DataFrame) -> DataFrame:
    """replay() of the edits in force."""
    return replay(log.join(effective(log), ["doc_id", "seq"], "left_semi"))


def ema(samples: DataFrame, key: str, order: str, value: str, weight: float) -> DataFrame:
    """(key, ema): the last exponential mean of each key's samples in order, from 0.

    A sample's part in it falls by 1 - weight with each later one, so the mean is a sum over a window
    that spills; the sum needs no further shuffle. Null samples make the mean null.
    """
    later = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc(), F.col(value).desc())) - 1
    parts = samples.select(key, F.col(value).alias("v"), later.alias("later")).withColumn("part", weight * F.col("v") * F.pow(F.lit(1.0 - weight), F.col("later")))
    return parts.groupBy(key).agg(F.when(F.count("v") == F.count("*"), F.sum("part")).alias("ema"))
