"""A stream of tile writes into a versioned store: late versions are rejected, equal ones replace.

Keyed state holds each tile's version only; accepted writes go to the output in order of arrival.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mosaiq.operators.cache import latest
from mosaiq.session import remove_folder, ship_package, subfolders

OUT = "tx int, ty int, arrival long, version long, payload double"
STATE = "version long"


def accept(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows whose version is not below the stored one, which then moves on."""
    held = state.get[0] if state.exists else None
    rows = pd.concat(list(frames)).sort_values("arrival")
    best = rows["version"].cummax().shift(1)
    if held is not None:
        best = best.fillna(held).clip(lower=held)
    taken = rows[best.isna() | (rows["version"] >= best)]
    if len(taken):
        state.update((int(max(taken["version"].max(), held if held is not None else taken["version"].max())),))
        yield taken[["tx", "ty", "arrival", "version", "payload"]]


def accepted_writes(writes: DataFrame) -> DataFrame:
    """The writes of a stream (tx, ty, arrival, version, payload) that the store accepts."""
    ship_package(writes.sparkSession)
    return writes.groupBy("tx", "ty").applyInPandasWithState(accept, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


COLUMNS = ["tx", "ty", "arrival", "version", "payload"]


def append_to(path: str):
    """A foreachBatch function that adds each batch's latest tiles to a store, as one folder a batch.

    A batch costs what it holds, not what the store holds. A batch that is run again replaces its folder.
    """

    def run(batch: DataFrame, number: int) -> None:
        latest(batch.select(*COLUMNS)).select(*COLUMNS).write.mode("overwrite").parquet(f"{path}/batch-{number:012d}")

    return run


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The latest tile of each place over all folders of a store."""
    folders = [f"{path}/{f}" for f in subfolders(spark, path)]
    if not folders:
        return spark.createDataFrame([], OUT)
    return latest(spark.read.schema(OUT).parquet(*folders)).select(*COLUMNS)


def compact(spark: SparkSession, path: str) -> None:
    """Put all folders of a store but the newest into one. Run it beside the stream now and then, one at a time.

    A reader that lists both the old folders and the new one sees writes twice, which changes nothing.
    The newest folder stays as it is: its batch may yet be run again.
    """
    names = subfolders(spark, path)[:-1]
    if len(names) < 2:
        return
    merged = latest(spark.read.schema(OUT).parquet(*(f"{path}/{f}" for f in names))).select(*COLUMNS)
    merged.write.mode("overwrite").parquet(f"{path}/{names[-1]}-merged")
    for name in names:
        remove_folder(spark, f"{path}/{name}")
