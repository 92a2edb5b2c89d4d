"""Exact top-k inner products by norm buckets.

Vectors are sorted by length and cut into buckets, a bucket being one row. Queries are cut into
blocks the same way. A block meets the group of the longest buckets of its dimension first, which
gives each query a lower bound for its k-th score; then every other group whose longest vector can
reach some query's bound. Inside, a query needs of each bucket a cosine of bound / (its length *
the bucket's longest). Above 1 the bucket is skipped. Else the bucket is pruned in one of two ways,
whichever the threshold makes cheaper:

- length: vectors that are long enough are taken, a head of the bucket;
- coordinates: products are summed over the query's largest coordinates only, and what the others
  can add is at most the product of both rests' lengths. This works at equal lengths too.

What remains is verified by whole products. Bounds rise as a task goes from bucket to bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, prepare, release_memory
from .exchange import decode_table, encode_table

BUCKET = 512
#: Buckets that one task takes, and bytes of the queries that it holds against them.
GROUP, QUERY_BYTES = 16, 8 << 20
#: Shares of a query's coordinates that may be summed first.
FOCUS = (1 / 8, 1 / 4, 1 / 2)
#: Relative slack for rounding in lengths and cosines; pruning only, products are exact.
SLACK = 1e-9
#: Products of doubles are exact below this bound; beyond it integers are multiplied.
EXACT = 2.0**52


def scaled(column: pa.Array, scale: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which vectors take part (not null, no null or non-finite component), and floor(scale * x) of those."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows, use = [], np.zeros(len(column), dtype=bool)
    lists = column.cast(pa.list_(pa.float64()))
    values = lists.flatten()
    bad = ~np.isfinite(values.fill_null(np.nan).to_numpy(zero_copy_only=False))
    numbers = np.floor(scale * np.where(bad, 0.0, values.fill_null(0.0).to_numpy(zero_copy_only=False)))
    valid = lists.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.where(valid, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
    ends = np.cumsum(sizes)
    for i, (a, b) in enumerate(zip(ends - sizes, ends, strict=True)):
        if valid[i] and not bad[a:b].any():
            use[i] = True
            rows.append(numbers[a:b])
    return use, rows


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whole inner products of all rows of left with all rows of right, as 64-bit integers."""
    if not left.size or not right.size:
        return np.zeros((len(left), len(right)), np.int64)
    if np.abs(left).max() * np.abs(right).max() * left.shape[1] < EXACT:
        return (left @ right.T).astype(np.int64)
    return left.astype(np.int64) @ right.astype(np.int64).T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        limit = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= limit)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def focus_of(query: np.ndarray, length: float, cosine: float) -> np.ndarray | None:
    """The coordinates of a query to sum first, or None where pruning by length is cheaper.

    A share f of the coordinates that holds a share e of the query leaves at most sqrt(1 - e) of it,
    and about sqrt(1 - f) of a vector. Cosines over them spread by about sqrt(e / dimension), so the
    part of the vectors to verify is about what of a bell curve is above the threshold less the rests.
    """
    if cosine <= 0 or length == 0:
        return None
    order = np.argsort(-np.abs(query), kind="stable")
    energy = np.cumsum(query[order] ** 2) / length**2
    best, choice = 1.0, None
    for share in FOCUS:
        f = max(1, int(share * len(query)))
        e = min(1.0, float(energy[f - 1]))
        margin = cosine - math.sqrt((1 - e) * (1 - f / len(query)))
        cost = f / len(query) + 0.5 * math.erfc(margin / math.sqrt(2 * e / len(query)))
        if cost < best:
            best, choice = cost, order[:f]
    return choice


def candidates(query: np.ndarray, length: float, bound: float, vectors: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places in a bucket, sorted by falling length, that may reach the bound."""
    longest = float(lengths[0])
    if bound <= 0 or length == 0 or longest == 0:
        return np.arange(len(lengths)) if bound <= 0 else np.zeros(0, np.int64)
    cosine = bound / (length * longest) - SLACK
    if cosine > 1:
        return np.zeros(0, np.int64)
    head = int(np.searchsorted(-lengths, -(bound / length) * (1 - SLACK), side="right"))
    focus = focus_of(query, length, cosine)
    if focus is None:
        return np.arange(head)
    some, part = vectors[:head, focus], query[focus]
    rest = max(0.0, length**2 - float(part @ part))
    others = np.maximum(0.0, lengths[:head] ** 2 - np.einsum("ij,ij->i", some, some))
    return np.flatnonzero(some @ part + np.sqrt(rest * others) * (1 + SLACK) + SLACK * length * longest >= bound)


def _matrix(blobs: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(-1, dim) if dim else np.zeros((len(blobs), 0))


BLOCKS = "dim int, number long, size long, longest double, payload binary"


def _cut(size_of, group: int):
    """Rows (number, ...) of up to size_of(dimension) vectors of one dimension; a partition is sorted by dimension and falling length.

    So many numbers in a row are a group, and a group holds one dimension.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.Table] = []

        def out(rows: pa.Table) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"dim": pa.array([rows.column("dim")[0].as_py()], pa.int32()), "number": pa.array([number], pa.int64()), "size": pa.array([rows.num_rows], pa.int64()), "longest": pa.array([rows.column("length")[0].as_py()], pa.float64()), "payload": pa.array([encode_table(rows.select(["rid", "vec_id", "vector"]).combine_chunks())], pa.binary())})

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows = pa.concat_tables(held)
            dims = rows.column("dim").to_numpy()
            at = 0
            while at < rows.num_rows:
                end = at + int(np.searchsorted(dims[at:] != dims[at], True)) if (dims[at:] != dims[at]).any() else rows.num_rows
                whole = min(end, at + size_of(int(dims[at])))
                if whole == rows.num_rows and whole - at < size_of(int(dims[at])):
                    break
                yield out(rows.slice(at, whole - at))
                number, at = (number + 1 if whole < end else (number // group + 1) * group), whole
            held = [rows.slice(at)] if at < rows.num_rows else []
        if held and held[0].num_rows:
            yield out(pa.concat_tables(held))
        release_memory()

    return run


RESULT = pa.schema([("block", pa.int64()), ("rid", pa.int64()), ("query_id", pa.int64()), ("length", pa.float64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class Search:
    """The queries of a block with the best of what they have met, and how many products that took."""

    def __init__(self, payload: bytes, dim: int, k: int, bounds: dict[int, float]):
        rows = decode_table(payload)
        self.rid, self.ids = rows.column("rid").to_numpy(), rows.column("vec_id").to_numpy()
        self.vectors = _matrix(rows.column("vector").to_pylist(), dim)
        self.lengths = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        self.k, self.dim, self.met, self.verified = k, dim, 0, 0
        self.bounds = np.array([bounds.get(int(r), -np.inf) for r in self.rid])
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in self.rid]

    def meet(self, payload: bytes) -> None:
        rows = decode_table(payload)
        rid, ids = rows.column("rid").to_numpy(), rows.column("vec_id").to_numpy()
        vectors = _matrix(rows.column("vector").to_pylist(), self.dim)
        lengths = np.sqrt((vectors * vectors).sum(axis=1))
        order = np.argsort(-lengths, kind="stable")
        rid, ids, vectors, lengths = rid[order], ids[order], vectors[order], lengths[order]
        for i, query in enumerate(self.vectors):
            place = candidates(query, float(self.lengths[i]), float(self.bounds[i]), vectors, lengths)
            place = place[rid[place] != self.rid[i]]
            self.met += len(ids)
            self.verified += len(place)
            if not len(place):
                continue
            scores = np.concatenate([self.found[i][0], products(query[None], vectors[place])[0]])
            names = np.concatenate([self.found[i][1], ids[place]])
            top = best(scores, names, self.k)
            self.found[i] = (scores[top], names[top])
            if len(top) == self.k:
                self.bounds[i] = max(self.bounds[i], float(scores[top].min()))

    def result(self, block: int) -> pa.Table:
        sizes = [len(s) for s, _ in self.found]
        whole = np.repeat(np.arange(len(sizes)), sizes)
        scores, names = (np.concatenate([f[i] for f in self.found]) if self.found else np.zeros(0, np.int64) for i in (0, 1))
        return pa.table([pa.array(np.full(len(whole), block)), pa.array(self.rid[whole]), pa.array(self.ids[whole]), pa.array(self.lengths[whole]), pa.array(names), pa.array(scores)], schema=RESULT)


def _search(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """left: one block of queries with their bounds; right: the buckets of one group."""
        if not left.num_rows or not right.num_rows:
            return RESULT.empty_table()
        block = left.slice(0, 1).to_pylist()[0]
        search = Search(block["payload"], block["dim"], k, {b["rid"]: b["bound"] for b in block["bounds"] or []})
        order = np.argsort(-right.column("longest").to_numpy(), kind="stable")
        payloads = right.column("payload")
        for i in order:
            search.meet(payloads[int(i)].as_py())
        release_memory()
        return search.result(block["number"])

    return run


def top_k(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", query_every: int = 100, k: int = 10, scale: float = 1024.0) -> DataFrame:
    """For each row whose id is divisible by query_every, its k highest inner products with all other rows.

    Components are first turned into floor(scale * x). Columns: query_id, rank (from 1), vec_id,
    score; ties go to the smaller vec_id. Vectors that are null or hold null or non-finite
    components take no part, nor do rows without an id; vectors of different dimensions have no
    product; other rows with the query's own id are candidates like any; a repeated query row gets
    its own result; other columns are ignored; an empty table gives an empty result. Scores must
    fit 64 bits. A vector of any length takes part whole; a bucket of such vectors must fit a worker.
    """

    prepare(vectors.sparkSession, 10_000)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            use, rows = scaled(batch.column(2), scale)
            keep = pa.array(use)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array([len(r) for r in rows], pa.int32()), pa.array([float(np.sqrt((r * r).sum())) for r in rows], pa.float64()), pa.array([r.tobytes() for r in rows], pa.binary())],
                ["rid", "vec_id", "dim", "length", "vector"],
            )
        release_memory()

    shape = "rid long, vec_id long, dim int, length double, vector binary"
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    parsed = materialize(rows.mapInArrow(parse, shape), "topk-vectors")
    order = [F.col("dim"), F.col("length").desc(), F.col("vec_id"), F.col("rid")]

    def cut(some: DataFrame, size_of, rows_a_part: int, label: str) -> DataFrame:
        parts = max(1, -(-some.count() // rows_a_part))
        return materialize(some.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_cut(size_of, group), BLOCKS), label)

    bucket, query_bytes, group = BUCKET, QUERY_BYTES, GROUP
    buckets = cut(parsed, lambda dim: bucket, GROUP * BUCKET, "topk-buckets").withColumn("group", F.floor(F.col("number") / GROUP).cast("long"))
    blocks = cut(parsed.where(F.col("vec_id") % query_every == 0), lambda dim: max(64, query_bytes // (8 * max(1, dim))), 1 << 15, "topk-queries")
    groups = materialize(buckets.groupBy("dim", "group").agg(F.max("longest").alias("longest")), "topk-groups")
    schema = "block long, rid long, query_id long, length double, vec_id long, score long"

    def meet(asking: DataFrame) -> DataFrame:
        """Each (block, group) of asking is one task, with a copy of the group's buckets."""
        pairs = asking.select(F.col("number").alias("to"), F.col("group").alias("of"))
        right = buckets.join(pairs, F.col("group") == F.col("of")).select("to", "of", "longest", "payload")
        return asking.groupBy("number", "group").cogroup(right.groupBy("to", "of")).applyInArrow(_search(k), schema)

    first = groups.groupBy("dim").agg(F.min_by("group", F.struct(-F.col("longest"), F.col("group"))).alias("group"))
    none = F.lit(None).cast("array<struct<rid: bigint, bound: double>>").alias("bounds")
    seed = materialize(meet(blocks.join(first, "dim").select("number", "group", "dim", "payload", none)), "topk-seed")
    per_query = seed.groupBy("block", "rid", "length").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("least")).where(F.col("n") == k)
    # A block asks for a group only if the group's longest vector can reach the bound of some query of the block.
    needs = per_query.groupBy("block").agg(F.collect_list(F.struct("rid", F.col("least").alias("bound"))).alias("bounds"), F.count("*").alias("bounded"), F.min(F.when(F.col("least") > 0, F.col("least") / F.col("length")).otherwise(float("-inf"))).alias("need"))
    known = materialize(blocks.join(needs, blocks["number"] == needs["block"], "left").select("dim", "number", "payload", "bounds", F.when(F.col("bounded") == F.col("size"), F.col("need")).otherwise(float("-inf")).alias("need")), "topk-bounds")
    wanted = known.select("dim", "number", "need").join(groups.join(first.withColumnRenamed("group", "seeded"), "dim").where("group <> seeded"), "dim").where(F.col("longest") * (1 + 1e-9) >= F.col("need")).select("number", "group")
    found = seed.unionByName(meet(materialize(wanted, "topk-wanted").join(known.select("number", "dim", "payload", "bounds"), "number").select("number", "group", "dim", "payload", "bounds")))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("rid").orderBy(F.col("score").desc(), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
