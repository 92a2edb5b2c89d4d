"""Near-duplicate groups by an inverted join on MinHash signature coordinates.

1. A document's set of word shingles becomes a signature of COORDINATES minima; documents with the
   same set are one class from here on, so copies cost one row each.
2. Every class is posted under its (coordinate, value) pairs, and the bundles learn from the slots
   of the hash space how many classes have each pair: the lengths of the posting lists. Lists of
   one can't collide. Prefix: a class keeps its shortest lists only, all but threshold - 1 of those
   it shares; two classes that agree on the threshold meet in one of them. Skip: a class that
   shares fewer lists than the threshold is left out.
3. In every list, each class is merged with the list's first one: collisions are counted over both
   signatures, and pairs at the threshold are confirmed on the full sets. That is linear.
4. Skip: a list whose classes are in one component by now has nothing to add. In any other, the
   classes outside its largest component are merged with those of other components, block against
   block, so that a list of any length is split over tasks. Two classes that share several lists
   meet in the one of the least coordinate only. Those that collide with none go; the rest are confirmed.
5. Components of the links. A task returns a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .common import Words, discard, materialize, mix, odd_numbers, prepare, release_memory, rows_kept, slices, tables_written, window_hashes
from .components import components
from .exchange import ASKED, BUNDLE, answer, ask, decode_table, encode_table, find, group_starts, with_answers

COORDINATES = 64
#: At a similarity of 0.75, 64 coordinates agree on fewer than 30 with a probability near 1e-6.
MATCHES = 30
SHINGLE = 5
#: Classes, and shingles of classes, that one task holds on a side.
BLOCK, BLOCK_SHINGLES = 512, 4 << 20
#: Classes of which one task compares the signatures, on a side.
PEERS = 4096
#: Of the filter that texts pass before they are moved: bits for each class, bits in a page, pages at most (8 MB in all).
BITS, PAGE, PAGES = 16, 32768, 2048
ROWS_PER_BUNDLE = 10_000


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The ascending distinct shingle hashes of each text; a shorter text is one shingle, one without words has none."""
    words = Words(texts, lower=True)
    hashes = words.hashes()
    grams = window_hashes(hashes, width, 41)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            out.append(window_hashes(hashes[a:b], int(b - a), 43 + int(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of COORDINATES 32-bit minima for each set, which must not be empty."""
    if not sets:
        return np.zeros((0, COORDINATES), np.uint32)
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), COORDINATES), np.uint32)
    turn, by = odd_numbers(COORDINATES, 5), odd_numbers(COORDINATES, 6)
    held = np.empty_like(flat)
    for k in range(COORDINATES):
        np.bitwise_xor(flat, turn[k], out=held)
        np.multiply(held, by[k], out=held)
        out[:, k] = np.minimum.reduceat(held, starts) >> np.uint64(32)
    return out


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column(1), width)
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            full = np.flatnonzero(sizes)
            rows = signatures([sets[i] for i in full])
            blobs: list[bytes | None] = [None] * len(sets)
            key1, key2 = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
            for at, i in enumerate(full):
                blobs[i] = rows[at].tobytes()
                key1[i] = np.add.reduce(mix(sets[i] ^ np.uint64(77))).view(np.int64)
                key2[i] = np.add.reduce(mix(sets[i] + np.uint64(99))).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), pa.array(sizes), pa.array(key1), pa.array(key2), pa.array(blobs, pa.binary())], ["doc_id", "text_hash", "n_shingles", "key1", "key2", "signature"])
        release_memory()

    return run


def _bundle_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    bid = TaskContext.get().partitionId() << 24
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_PER_BUNDLE):
            yield pa.RecordBatch.from_pydict({"bid": pa.array([bid], pa.int64()), "payload": pa.array([encode_table(batch.slice(at, ROWS_PER_BUNDLE))], pa.binary())})
            bid += 1


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _pair_keys(matrix: np.ndarray) -> np.ndarray:
    """A 64-bit key of each (coordinate, value), without collisions, spread over the whole range."""
    return mix(matrix.astype(np.uint64) | np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32))


def _post(fan: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bid, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys, counts = np.unique(_pair_keys(_matrix(decode_table(payload.as_py()).column(2))), return_counts=True)
                yield ask(bid, keys, [counts.astype(np.int64)], fan)

    return run


def _totals(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    values, place = np.unique(keys, return_inverse=True)
    return values, [np.bincount(place, columns[0], len(values)).astype(np.int64)]


def _shared(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Pairs that two classes or more have, with their number."""
    values, (total,) = _totals(keys, columns)
    often = total[np.searchsorted(values, keys)]
    return often > 1, [often]


def _prefixes(matches: int):
    schema = pa.schema([("node", pa.int64()), ("signature", pa.binary()), ("prefix", pa.int64()), ("posts", pa.list_(pa.int64()))])

    def run(bid: int, rows: pa.RecordBatch | None, keys: np.ndarray, columns: list[np.ndarray]) -> pa.Table:
        if rows is None or not len(keys):
            return schema.empty_table()
        mine = _pair_keys(_matrix(rows.column(2)))
        found, at = find(mine.ravel(), keys)
        often = np.where(found, columns[0][at], 0).reshape(mine.shape)
        live = np.flatnonzero((often > 0).sum(axis=1) >= matches)
        posts, prefix = [], np.zeros(len(live), np.uint64)
        for at, i in enumerate(live):
            have = np.flatnonzero(often[i])
            order = have[np.lexsort((mine[i, have], often[i, have]))][: len(have) - matches + 1]
            posts.append(mine[i, order].view(np.int64))
            prefix[at] = np.bitwise_or.reduce(np.uint64(1) << order.astype(np.uint64))
        return pa.table([rows.column(0).take(live), rows.column(2).take(live), pa.array(prefix.view(np.int64)), pa.array(posts, schema.field("posts").type)], schema=schema)

    return run


def confirmed(sets: list[np.ndarray], close: np.ndarray, least: Fraction) -> np.ndarray:
    """Of the pairs (i < j) marked in close, those whose Jaccard similarity is least or more."""
    out = np.zeros_like(close)
    rows = np.flatnonzero(close.any(axis=0) | close.any(axis=1))
    if not len(rows):
        return out
    sizes = np.array([len(sets[i]) for i in rows], dtype=np.int64)
    flat = np.concatenate([sets[i] for i in rows])
    values, codes, often = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(rows)), sizes)
    place = np.cumsum(often > 1) - 1
    keep = often[codes] > 1
    owner, codes, width = owner[keep], place[codes[keep]], int((often > 1).sum())
    common = np.zeros((len(rows), len(rows)), dtype=np.float32)
    step = max(256, (16 << 20) // len(rows))
    order = np.argsort(codes, kind="stable")
    owner, codes = owner[order], codes[order]
    for low in range(0, width, step):
        a, b = np.searchsorted(codes, [low, low + step])
        part = np.zeros((len(rows), min(step, width - low)), dtype=np.float32)
        part[owner[a:b], codes[a:b] - low] = 1
        common += part @ part.T
    common = np.rint(common).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - common
    out[np.ix_(rows, rows)] = common * least.denominator >= union * least.numerator
    return out & close


def spanning_links(near: np.ndarray) -> list[tuple[int, int]]:
    """Links (member, least member) of the components of a symmetric relation given by its upper half."""
    near = near | near.T
    label = np.arange(len(near))
    live = np.flatnonzero(near.any(axis=1))
    while len(live):
        before = label.copy()
        for i in live:
            label[i] = min(label[i], label[near[i]].min())
        label = label[label]
        if (label == before).all():
            break
    return [(int(i), int(label[i])) for i in live if label[i] != i]


def collisions(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many coordinates each row of left has in common with each row of right."""
    out = np.zeros((len(left), len(right)), dtype=np.uint8)
    for k in range(COORDINATES):
        out += left[:, None, k] == right[None, :, k]
    return out


def met_before(left: np.ndarray, right: np.ndarray, left_prefix: np.ndarray, right_prefix: np.ndarray, coordinate: int) -> np.ndarray:
    """Whether each row of left shares a posting list of a lesser coordinate with each row of right; a prefix has a bit for each coordinate posted."""
    out = np.zeros((len(left), len(right)), dtype=bool)
    for k in range(coordinate):
        mine, others = (x >> np.uint64(k) & np.uint64(1) != 0 for x in (left_prefix, right_prefix))
        out |= (left[:, None, k] == right[None, :, k]) & mine[:, None] & others[None, :]
    return out


def _cases(*by: np.ndarray, node: np.ndarray) -> Iterator[np.ndarray]:
    """The rows of each comparison, ordered; it is named by one column or more."""
    order = np.lexsort((node, *by[::-1]))
    at = np.flatnonzero(group_starts(*(x[order] for x in by))) if len(order) else []
    return (order[a:b] for a, b in zip(at, [*at[1:], len(order)], strict=True))


def _sides(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each comparison in the table: its rows, ordered, and a matrix of which pairs of them it is to look at."""
    case, side, node = (table.column(c).to_numpy() for c in ("case", "side", "node"))
    group = table.column("component").to_numpy()
    for rows in _cases(case, node=node):
        # The sides meet each other; never within a component.
        meet = side[rows][:, None] != side[rows][None, :]
        yield rows, np.triu(meet & (group[rows][:, None] != group[rows][None, :]), 1)


def _blocks(rows: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """rows in runs of BLOCK at most that weigh about BLOCK_SHINGLES, or are one heavier row."""
    starts = group_starts(np.arange(len(rows)) // BLOCK, np.cumsum(weights[rows]) // BLOCK_SHINGLES)
    return np.split(rows, np.flatnonzero(starts)[1:])


#: What a row of a posting list does there: it is outside the largest component and asks the others; it is in that component; or it is asked but asks too.
ASKS, RESTS, ASKED_TOO = 0, 1, 2


def _collide(matches: int):
    """The rows of each comparison that collide with another often enough, in cases of a block against a block."""
    schema = pa.schema([("case", pa.int64()), ("side", pa.int32()), ("node", pa.int64()), ("component", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        signature, prefix = _matrix(table.column("signature")), table.column("prefix").to_numpy().view(np.uint64)
        case, post, side, node, group, weight = (table.column(c).to_numpy() for c in ("case", "post", "side", "node", "component", "n_shingles"))
        out: list[tuple[np.ndarray, ...]] = []
        for rows in _cases(post, case, node=node):
            coordinate = int(np.flatnonzero(_pair_keys(signature[rows[:1]])[0].view(np.int64) == post[rows[0]])[0])
            asks, asked = (_blocks(rows[x], weight) for x in (side[rows] == ASKS, side[rows] != ASKS))
            for i, left in enumerate(asks):
                for j, right in enumerate(asked):
                    # Where both ask, one of them does.
                    close = (group[left][:, None] != group[right][None, :]) & ((side[right] == RESTS)[None, :] | (node[left][:, None] < node[right][None, :]))
                    if close.any():
                        close &= collisions(signature[left], signature[right]) >= matches
                    if close.any():
                        close &= ~met_before(signature[left], signature[right], prefix[left], prefix[right], coordinate)
                    for own, found in enumerate((left[close.any(axis=1)], right[close.any(axis=0)])):
                        name = mix(case[found].view(np.uint64) ^ mix(np.array([i << 32 | j], np.uint64))).view(np.int64)
                        out.append((name, np.full(len(found), own, np.int32), node[found], group[found]))
        release_memory()
        if not out:
            return schema.empty_table()
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], schema=schema)

    return run


def _confirm(least: Fraction, matches: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        node, sets = table.column("node").to_numpy(), table.column("shingles").to_pylist()
        signature = _matrix(table.column("signature"))
        links: list[tuple[int, int]] = []
        for rows, meet in _sides(table):
            close = meet & (collisions(signature[rows], signature[rows]) >= matches)
            if close.any():
                near = confirmed([np.frombuffer(sets[i], np.uint64) for i in rows], close, least)
                links += [(int(node[rows[i]]), int(node[rows[j]])) for i, j in spanning_links(near)]
        a, b = zip(*links, strict=True) if links else ((), ())
        release_memory()
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return run


def _with_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [x.tobytes() for x in shingle_sets(batch.column(1), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), batch.column(2), batch.column(3), pa.array(sets, pa.binary())], ["node", "n_shingles", "signature", "prefix", "shingles"])
        release_memory()

    return run


#: Comparisons that share a task where they are small.
CASES_PER_TASK = 256


def _tasks(cases: DataFrame, *by: str) -> DataFrame:
    """cases with a column case, a number for each comparison, and task: small comparisons share one, by hash."""
    return _retasked(cases.withColumn("case", F.xxhash64(*by)))


def _retasked(cases: DataFrame) -> DataFrame:
    bins = max(64, cases.count() // CASES_PER_TASK)
    return cases.withColumn("task", F.pmod(F.xxhash64("case", F.lit(1)), F.lit(bins)))


def links(posts: DataFrame, classes: DataFrame, least: Fraction, matches: int) -> DataFrame:
    """(a, b): a spanning set of the confirmed links between classes that share a post.

    posts: (node, post); classes: (node, n_shingles, signature, prefix, shingles), one row of each node.
    """
    first = posts.groupBy("post").agg(F.min("node").alias("first"), F.count("*").alias("length")).where("length > 1")
    listed = materialize(posts.join(first, "post"), "near-lists")
    pairs = listed.where("node <> first").select("node", "first").distinct().join(classes.select("node", "n_shingles"), "node")
    # A class that is first for many is compared with them in several blocks.
    blocks = pairs.groupBy("first").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = pairs.select("node", "first").join(blocks, "first").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = materialize(_tasks(placed.select("node", "first", "block"), "first", "block"), "near-pairs")
    sides = placed.select("case", "task", F.lit(1).alias("side"), "node").unionByName(placed.select("case", "task", F.lit(0).alias("side"), F.col("first").alias("node")).distinct())
    found = _compared(sides.withColumn("component", F.col("node")), classes, least, matches)
    labels = materialize(components(found), "near-labels")
    # The first of a list has met all others there.
    named = listed.where("length > 2 AND node <> first").join(labels, "node", "left").select("post", "node", F.coalesce("component", "node").alias("component"))
    parts = named.groupBy("post", "component").agg(F.count("*").alias("n"))
    several = parts.groupBy("post").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("largest")).where("parts > 1")
    several = several.select("post", F.col("largest.component").alias("largest"), *(F.ceil(n / PEERS).alias(c) for c, n in (("blocks", F.col("n")), ("asking", F.col("n") - F.col("largest.n")))))
    open_lists = materialize(named.join(several, "post").withColumn("asks", F.col("component") != F.col("largest")).drop("largest"), "near-open")
    own = F.xxhash64("node")
    asked = open_lists.select("post", "node", "component", F.when(F.col("asks"), ASKED_TOO).otherwise(RESTS).alias("side"), F.pmod(own, F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("asking") - 1)).alias("asker"))
    asks = open_lists.where("asks").select("post", "node", "component", F.lit(ASKS).alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.pmod(own, F.col("asking")).alias("asker"))
    cases = materialize(_tasks(asked.unionByName(asks), "post", "block", "asker").select("case", "post", "task", "side", "node", "component"), "near-cases")
    if cases.isEmpty():
        return found
    close = materialize(cases.join(classes.select("node", "n_shingles", "signature", "prefix"), "node").groupBy("task").applyInArrow(_collide(matches), "case long, side int, node long, component long"), "near-close")
    return found.unionByName(_compared(_retasked(close), classes, least, matches))


def _compared(sides: DataFrame, classes: DataFrame, least: Fraction, matches: int) -> DataFrame:
    held = sides.join(classes.select("node", "signature", "shingles"), "node")
    return materialize(held.groupBy("task").applyInArrow(_confirm(least, matches), "a long, b long"), "near-links")


def _likely(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows with the (doc_id, text_hash) of a (rep, class_hash) in wanted, and some others, so that few texts are moved to find them."""
    pages = min(PAGES, wanted.count() * BITS // PAGE + 1)
    spot = lambda *key: F.pmod(F.xxhash64(*key), F.lit(pages * PAGE))
    page, bit = (lambda c: F.floor(c / PAGE)), (lambda c: F.pmod(c, F.lit(PAGE)))
    bits = wanted.select(spot("rep", "class_hash").alias("spot")).groupBy(page(F.col("spot")).alias("page")).agg(F.bitmap_construct_agg(bit(F.col("spot"))).alias("bits"))
    at = bit(spot("doc_id", "text_hash"))
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.join(F.broadcast(bits), (page(spot("doc_id", "text_hash")) == F.col("page")) & (F.call_function("getbit", byte, F.pmod(at, F.lit(8)).cast("int")) == 1), "left_semi")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: Fraction = Fraction(3, 4), matches: int = MATCHES) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of their lower-cased shingle sets; one row per row of docs.

    Columns: doc_id, n_shingles, component_id (smallest id reachable over links), kept (it is the
    document's own), then text_hash (xxhash64 of the text, "" for null) and group (the same for
    linked rows, null for those without a shingle). Documents with fewer words than a shingle have
    one shingle, their whole sequence; without words or text they have none and link with nothing.
    Rows are documents of their own, also where they share an id. Rows without an id take no part:
    they have no component and are kept. A text of any length takes part whole; it must fit a
    worker's memory some thirty times over. Other columns are ignored; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    mark = tables_written()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    hashed = texts.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    signed = materialize(hashed.mapInArrow(_sign(shingle), "doc_id long, text_hash long, n_shingles long, key1 long, key2 long, signature binary"), "near-signatures")
    # A class is named by its place in the table of classes, whatever ids its rows have; its text is that of a row with the smallest.
    sets = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("key1", "key2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min_by("text_hash", "doc_id").alias("text_hash"), F.min("signature").alias("signature"))
    classes = materialize(sets.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    bundles = materialize(classes.select("node", "n_shingles", "signature").mapInArrow(_bundle_classes, BUNDLE), "near-bundles")
    often = answer(bundles.mapInArrow(_post(exchange.FAN), ASKED), bundles.count(), ["i8"], _totals, _shared, ["i8"])
    live = materialize(with_answers(bundles, often, ["i8"], _prefixes(matches), "node long, signature binary, prefix long, posts array<long>"), "near-posts")
    named = materialize(live.select("node", "signature", "prefix").join(classes.select("node", "n_shingles", "rep", F.col("text_hash").alias("class_hash")), "node"), "near-wanted")
    found = _likely(hashed, named).join(named, (F.col("doc_id") == F.col("rep")) & (F.col("text_hash") == F.col("class_hash"))).select("node", "text", "signature", "prefix", "n_shingles").dropDuplicates(["node"])
    with_sets = materialize(found.mapInArrow(_with_sets(shingle), "node long, n_shingles long, signature binary, prefix long, shingles binary"), "near-sets")
    groups = materialize(components(links(live.select("node", F.explode("posts").alias("post")), with_sets, similarity, matches)), "near-groups")
    member = classes.select("key1", "key2", "n_shingles", "rep", "node").join(groups, "node", "left").withColumn("group", F.coalesce("component", "node"))
    least = member.groupBy("group").agg(F.min("rep").alias("component_id"))
    of_class = materialize(member.select("key1", "key2", "n_shingles", "group").join(least, "group"), "near-named")
    discard(spark, mark, (signed, of_class))
    out = signed.drop("signature").join(of_class, ["key1", "key2", "n_shingles"], "left")
    has_id = F.col("doc_id").isNotNull()
    out = out.select("doc_id", "n_shingles", F.when(has_id, F.coalesce("component_id", "doc_id")).alias("component_id"), "text_hash", F.when(has_id, F.col("group")).alias("group"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "text_hash", "group")


def without_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of docs with one of each group of near_duplicates(): the one with the smallest id.

    Of several rows with that id in a group, the one with the smallest text_hash stays, then the one
    whose other columns come first. Rows that link with nothing stay, and so do rows without an id.
    """
    found = materialize(near_duplicates(docs, id_col=id_col, text_col=text_col, **settings), "near-found")
    rivals = found.where("kept AND group IS NOT NULL").groupBy("group").agg(F.count("*").alias("n"), F.min("text_hash").alias("best")).where("n > 1")
    rivals = materialize(rivals, "near-rivals")
    again = found.where("kept").join(rivals, "group").select("doc_id", "text_hash", (F.col("text_hash") == F.col("best")).alias("stays"))
    again = materialize(again, "near-again")
    verdicts = found.select("doc_id", "text_hash", "kept")
    if not again.isEmpty():
        lost = again.where("NOT stays").select("doc_id", "text_hash", F.lit(True).alias("lost")).distinct()
        verdicts = verdicts.join(lost, ["doc_id", "text_hash"], "left").select("doc_id", "text_hash", (F.col("kept") & F.col("lost").isNull()).alias("kept"))
    rest = rows_kept(docs, verdicts, id_col, text_col)
    if again.isEmpty():
        return rest
    same = again.where("stays").groupBy(F.col("doc_id").alias("same id"), F.col("text_hash").alias("same hash")).agg(F.count("*").alias("n")).where("n > 1").select("same id", "same hash")
    match = (rest[id_col] == F.col("same id")) & (F.xxhash64(F.coalesce(rest[text_col], F.lit(""))) == F.col("same hash"))
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    one = rest.join(same, match, "left_semi").groupBy(id_col, text_col).agg(F.min(F.struct(*others) if others else F.lit(0)).alias("other columns"))
    return rest.join(same, match, "left_anti").unionByName(one.select(id_col, text_col, *(F.col("other columns")[c].alias(c) for c in others)).select(*docs.columns))
