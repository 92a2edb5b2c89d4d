"""Questions from groups of documents to shares of a hash space, and the answers back.

A bundle is some megabytes of rows in one compressed cell, with an id that is fixed by writing it.
A task asks about the distinct hashes of a bundle: it sorts them and sends each of FAN equal shares
of the hash range, as one row, to that share's slot.

Up to PER_BUCKET * FAN bundles, a slot is answered at once. Beyond, the slot's bundles form groups
of that many. A group adds equal hashes up, and asks on its own behalf, FAN finer slots each time,
until slots are small enough; the answers go back the same way. So each bundle writes FAN rows
and each group FAN more, whatever their number: rows are in proportion to the input, and a value
that all bundles have costs a slot one entry per group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, materialize, prepare, release_memory, slices

#: Slots that one bundle, or one group, asks.
FAN = 48
#: Bundles whose whole questions one task should hold; less than FAN.
PER_BUCKET = 8

BUNDLE = "bid long, payload binary"


def encode_table(table: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write(table)
    return sink.getvalue().to_pybytes()


def decode_table(blob: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(blob) as reader:
        return reader.read_next_batch()


def gathered(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows of a partition in batches of about limit bytes of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for piece in slices(batches, text, limit):
        held.append(piece)
        size += piece.nbytes
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def bundle(rows: DataFrame, text: str, label: str, limit: int = CHUNK_BYTES) -> DataFrame:
    """rows in bundles of about limit bytes of text, written to the scratch folder."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bid = TaskContext.get().partitionId() << 24
        for whole in gathered(batches, text, limit):
            yield pa.RecordBatch.from_pydict({"bid": pa.array([bid], pa.int64()), "payload": pa.array([encode_table(whole)], pa.binary())})
            bid += 1
        release_memory()

    prepare(rows.sparkSession)
    return materialize(rows.mapInArrow(make, BUNDLE), label)


def levels_for(bundles: int) -> int:
    """How often slots are refined: FAN ** levels slots share the questions of so many bundles."""
    levels = 1
    while bundles > PER_BUCKET * FAN**levels:
        levels += 1
    return levels


def slot_of(spread: np.ndarray, slots: int) -> np.ndarray:
    """The equal share of the 64-bit range in which each value lies. A slot's FAN finer slots lie within it."""
    return ((spread >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)


_ZSTD = pa.Codec("zstd", 1)


def _squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def _expand(blob: bytes) -> np.ndarray:
    size = int.from_bytes(blob[:8], "little")
    return np.frombuffer(_ZSTD.decompress(blob[8:], size) if size else b"", np.uint8)


def _planes(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, as most have few bytes that are not zero."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()


def _from_planes(raw: np.ndarray, kind: str) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as differences."""
    return _squeeze(_planes(np.diff(keys, prepend=np.uint64(0)).astype("<u8")))


def unpack_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(_expand(blob), "<u8"), dtype=np.uint64)


def pack_columns(columns: list[np.ndarray]) -> bytes:
    return _squeeze(b"".join(map(_planes, columns)))


def unpack_columns(blob: bytes, kind: str) -> np.ndarray:
    """The one column that was packed."""
    return _from_planes(_expand(blob), kind)


def unpack(keys: list[bytes], extra: list[bytes], kinds: list[str]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """All keys, the extra columns of the given numpy types, and how many keys each row had."""
    parts = [unpack_keys(k) for k in keys]
    counts = np.array([len(p) for p in parts], dtype=np.int64)
    columns: list[list[np.ndarray]] = [[] for _ in kinds]
    for n, blob in zip(counts, extra, strict=True):
        raw, at = _expand(blob), 0
        for out, kind in zip(columns, kinds, strict=True):
            width = np.dtype(kind).itemsize * int(n)
            out.append(_from_planes(raw[at : at + width], kind))
            at += width
    whole = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return whole, [np.concatenate(c) if c else np.zeros(0, k) for c, k in zip(columns, kinds, strict=True)], counts


Spread = Callable[[np.ndarray], np.ndarray]
ASK = pa.schema([("slot", pa.int64()), ("bid", pa.int64()), ("keys", pa.binary()), ("extra", pa.binary())])
ASKED = "slot long, bid long, keys binary, extra binary"
ANSWER = "bid long, keys binary, extra binary"


def ask(bid: int, keys: np.ndarray, columns: list[np.ndarray], slots: int, spread: Spread | None = None) -> pa.RecordBatch:
    """Rows (slot, bid, keys, extra): ascending keys and, in extra, columns of the same length. Bundles ask FAN slots.

    spread turns keys into values that fill the 64-bit range, by which slots are chosen; keys that do so themselves need none.
    """
    slot = slot_of(keys if spread is None else spread(keys), slots)
    if spread is not None:
        order = np.argsort(slot, kind="stable")
        slot, keys, columns = slot[order], keys[order], [c[order] for c in columns]
    starts = np.flatnonzero(group_starts(slot))
    stops = np.append(starts[1:], len(slot)) if len(slot) else starts
    blobs = [pack_keys(keys[a:b]) for a, b in zip(starts, stops, strict=True)]
    extra = [pack_columns([c[a:b] for c in columns]) for a, b in zip(starts, stops, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(slot[starts]), pa.array(np.full(len(starts), bid)), pa.array(blobs, pa.binary()), pa.array(extra, pa.binary())], schema=ASK)


Combine = Callable[[np.ndarray, list[np.ndarray]], tuple[np.ndarray, list[np.ndarray]]]
Decide = Callable[[np.ndarray, list[np.ndarray]], tuple[np.ndarray, list[np.ndarray]]]


def entries(table: pa.Table, kinds: list[str]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """unpack() of the rows of a table of questions or answers."""
    return unpack(table.column("keys").to_pylist(), table.column("extra").to_pylist(), kinds)


def replies(bids: list[int], counts: np.ndarray, keys: np.ndarray, keep: np.ndarray, made: list[np.ndarray]) -> pa.Table:
    """Answer rows to bids, which had counts of the keys one after another: the kept keys with the columns made for them."""
    ends = np.concatenate([[0], np.cumsum(counts)])
    out = []
    for i, bid in enumerate(bids):
        part = slice(ends[i], ends[i + 1])
        if (chosen := keep[part]).any():
            out.append((bid, pack_keys(keys[part][chosen]), pack_columns([c[part][chosen] for c in made])))
    columns = list(zip(*out, strict=True)) or [(), (), ()]
    return pa.table({"bid": pa.array(columns[0], pa.int64()), "keys": pa.array(columns[1], pa.binary()), "extra": pa.array(columns[2], pa.binary())})


def settle(asked: DataFrame, units: int, levels: int, kinds: list[str], combine: Combine, finish: Callable[[DataFrame], DataFrame], made: list[str], spread: Spread | None = None, slots: int | None = None) -> DataFrame:
    """Answers (bid, keys, extra) to what units asked, by way of groups as far as levels say.

    combine(keys, columns) -> ascending distinct keys and their joined columns, in the same types;
    finish turns questions at the finest slots into answers with columns of the types in made.
    """
    slots = slots or FAN
    if levels == 1:
        return finish(asked)
    groups = -(-units // (PER_BUCKET * FAN if slots == FAN else FAN))
    held = materialize(asked.withColumn("node", F.col("slot") * groups + F.pmod(F.xxhash64("bid"), F.lit(groups))), "exchange")
    finer = slots * FAN

    def up(table: pa.Table) -> pa.Table:
        keys, columns, _ = entries(table, kinds)
        joined, values = combine(keys, columns)
        return pa.Table.from_batches([ask(table.column("node")[0].as_py(), joined, [v.astype(k) for v, k in zip(values, kinds, strict=True)], finer, spread)])

    def down(left: pa.Table, right: pa.Table) -> pa.Table:
        asking, _, counts = entries(left, kinds)
        keys, columns, _ = entries(right, made)
        order = np.argsort(keys, kind="stable")
        keys, columns = keys[order], [c[order] for c in columns]
        out, ends = [], np.concatenate([[0], np.cumsum(counts)])
        for i, bid in enumerate(left.column("bid").to_pylist()):
            mine = find(keys, asking[ends[i] : ends[i + 1]])[0]
            if mine.any():
                out.append((bid, pack_keys(keys[mine]), pack_columns([c[mine] for c in columns])))
        rows = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({"bid": pa.array(rows[0], pa.int64()), "keys": pa.array(rows[1], pa.binary()), "extra": pa.array(rows[2], pa.binary())})

    above = settle(held.groupBy("node").applyInArrow(up, ASKED), groups, levels - 1, kinds, combine, finish, made, spread, finer)
    return held.groupBy("node").cogroup(above.groupBy("bid")).applyInArrow(down, ANSWER)


def answer(asked: DataFrame, bundles: int, kinds: list[str], combine: Combine, decide: Decide, made: list[str], spread: Spread | None = None) -> DataFrame:
    """Per slot, decide(keys, columns) -> (which entries to answer, answer columns of all entries); keys come once for each asker."""

    def group(table: pa.Table) -> pa.Table:
        keys, columns, counts = entries(table, kinds)
        keep, values = decide(keys, columns)
        return replies(table.column("bid").to_pylist(), counts, keys, keep, values)

    return settle(asked, bundles, levels_for(bundles), kinds, combine, lambda rows: rows.groupBy("slot").applyInArrow(group, ANSWER), made, spread)


def with_answers(bundles: DataFrame, answers: DataFrame, kinds: list[str], apply: Callable[[int, pa.RecordBatch, np.ndarray, list[np.ndarray]], pa.Table], schema: str) -> DataFrame:
    """apply(bid, rows, ascending keys, answer columns) for each bundle; no answer means empty arrays."""
    return with_several_answers(bundles, [answers], [kinds], lambda bid, rows, found: apply(bid, rows, *found[0]), schema)


def with_several_answers(bundles: DataFrame, answers: list[DataFrame], kinds: list[list[str]], apply: Callable[[int, pa.RecordBatch, list[tuple[np.ndarray, list[np.ndarray]]]], pa.Table], schema: str) -> DataFrame:
    """apply(bid, rows, [(ascending keys, answer columns) of each kind of question]) for each bundle."""
    tagged = [a.select("bid", F.lit(i).alias("question"), "keys", "extra") for i, a in enumerate(answers)]
    every = tagged[0]
    for more in tagged[1:]:
        every = every.unionByName(more)

    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        for i, names in enumerate(kinds):
            rows = right.filter(pc.equal(right.column("question"), i)) if right.num_rows else right
            keys, columns, _ = unpack(rows.column("keys").to_pylist(), rows.column("extra").to_pylist(), names)
            order = np.argsort(keys, kind="stable")
            found.append((keys[order], [c[order] for c in columns]))
        release_memory()
        if not left.num_rows:
            return apply(-1, None, [(k[:0], [c[:0] for c in cs]) for k, cs in found])
        return apply(left.column("bid")[0].as_py(), decode_table(left.column("payload")[0].as_py()), found)

    return bundles.groupBy("bid").cogroup(every.groupBy("bid")).applyInArrow(group, schema)


def distinct(values: np.ndarray) -> np.ndarray:
    """Ascending distinct values."""
    values = np.sort(values)
    return values[group_starts(values)]


def group_starts(*sorted_columns: np.ndarray) -> np.ndarray:
    """True where a new group of equal rows begins."""
    first = np.ones(len(sorted_columns[0]), dtype=bool)
    if len(first):
        first[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])
    return first


def find(wanted: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each wanted value: whether it is in the ascending keys, and where first."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=bool), np.zeros(len(wanted), dtype=np.int64)
    # Searching in ascending order stays in the processor's cache, which is worth the sorting.
    order = np.argsort(wanted)
    at = np.empty(len(wanted), np.int64)
    at[order] = np.minimum(np.searchsorted(keys, wanted[order]), len(keys) - 1)
    return keys[at] == wanted, at
