"""Kernels over packed tiles, for throughput: NumPy inside Arrow batches, with the pixel operators as their definition."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.session import ship_package

TILES = "ty int, tx int, px int, py int, width int, height int, channels int, data binary"


def pack(px: DataFrame, tile: int, channels: tuple[str, ...] = ("r", "g", "b", "a")) -> DataFrame:
    """Pixels as tiles of float64 samples; pixels that a tile lacks are NaN."""
    ship_package(px.sparkSession)
    count = len(channels)

    def run(table: pa.Table) -> pa.Table:
        y, x = table.column("y").to_numpy(), table.column("x").to_numpy()
        ty, tx = int(y[0]) // tile, int(x[0]) // tile
        width, height = int(x.max()) % tile + 1, int(y.max()) % tile + 1
        out = np.full((height, width, count), np.nan)
        for i, c in enumerate(channels):
            out[y % tile, x % tile, i] = table.column(c).to_numpy()
        whole = lambda v: pa.array([v], pa.int32())
        return pa.table({"ty": whole(ty), "tx": whole(tx), "px": whole(tx * tile), "py": whole(ty * tile), "width": whole(width), "height": whole(height), "channels": whole(count), "data": pa.array([out.tobytes()], pa.binary())})

    keyed = px.select("y", "x", *channels, F.floor(F.col("y") / tile).alias("gy"), F.floor(F.col("x") / tile).alias("gx"))
    return keyed.groupBy("gy", "gx").applyInArrow(run, TILES)


def unpack(tiles: DataFrame, channels: tuple[str, ...] = ("r", "g", "b", "a")) -> DataFrame:
    """The pixels of packed tiles, without those that are NaN."""
    ship_package(tiles.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                px = np.frombuffer(r["data"]).reshape(-1, r["channels"])
                at = np.flatnonzero(~np.isnan(px[:, 0]))
                yield pa.RecordBatch.from_arrays([pa.array((r["py"] + at // r["width"]).astype(np.int32)), pa.array((r["px"] + at % r["width"]).astype(np.int32)), *(pa.array(px[at, i]) for i in range(len(channels)))], ["y", "x", *channels])

    return tiles.mapInArrow(run, "y int, x int, " + ", ".join(f"{c} double" for c in channels))


def on_tiles(tiles: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Tiles with kernel applied to each height x width x channels array, of the same shape."""
    ship_package(tiles.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index("data")
            made = [np.ascontiguousarray(kernel(np.frombuffer(d.as_py()).reshape(h, w, c))).tobytes() for d, h, w, c in zip(batch.column("data"), batch.column("height").to_pylist(), batch.column("width").to_pylist(), batch.column("channels").to_pylist(), strict=True)]
            yield batch.set_column(place, "data", pa.array(made, pa.binary()))

    return tiles.mapInArrow(run, tiles.schema)


def blur(tiles: DataFrame, radius: int, tile: int) -> DataFrame:
    """box_blur() of packed tiles: each gets the tiles within radius and sums by running totals, whatever the radius."""
    ship_package(tiles.sparkSession)
    reach = -(-radius // tile)
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    spread = tiles.withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps))
    spread = spread.withColumn("to_ty", F.col("ty") + F.col("dy")).withColumn("to_tx", F.col("tx") + F.col("dx"))

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        centre = next((r for r in rows if r["ty"] == r["to_ty"] and r["tx"] == r["to_tx"]), None)
        if centre is None:
            return table.schema.empty_table().select(["ty", "tx", "px", "py", "width", "height", "channels", "data"])
        y0, x0 = centre["py"] - radius, centre["px"] - radius
        area = np.full((centre["height"] + 2 * radius, centre["width"] + 2 * radius, centre["channels"]), np.nan)
        for r in rows:
            part = np.frombuffer(r["data"]).reshape(r["height"], r["width"], -1)
            ya, yb = max(y0, r["py"]), min(y0 + area.shape[0], r["py"] + r["height"])
            xa, xb = max(x0, r["px"]), min(x0 + area.shape[1], r["px"] + r["width"])
            if ya < yb and xa < xb:
                area[ya - y0 : yb - y0, xa - x0 : xb - x0] = part[ya - r["py"] : yb - r["py"], xa - r["px"] : xb - r["px"]]
        there = ~np.isnan(area)
        area = np.where(there, area, 0.0)
        for axis in (0, 1):
            side = 2 * radius + 1
            pad = [(1, 0) if a == axis else (0, 0) for a in range(3)]
            total, n = np.cumsum(np.pad(area, pad), axis=axis), np.cumsum(np.pad(there.astype(np.float64), pad), axis=axis)
            cutter = lambda v, s: v[s] if axis == 0 else v[:, s]  # noqa: E731, B023
            area = cutter(total, slice(side, None)) - cutter(total, slice(None, -side))
            n = cutter(n, slice(side, None)) - cutter(n, slice(None, -side))
            area, there = np.divide(area, n, out=np.zeros_like(area), where=n > 0), n > 0
        own = ~np.isnan(np.frombuffer(centre["data"]).reshape(area.shape))
        centre["data"] = np.where(own, area, np.nan).tobytes()
        return pa.Table.from_pylist([{k: centre[k] for k in ("ty", "tx", "px", "py", "width", "height", "channels", "data")}], schema=table.select(["ty", "tx", "px", "py", "width", "height", "channels", "data"]).schema)

    return spread.groupBy("to_ty", "to_tx").applyInArrow(run, TILES)
