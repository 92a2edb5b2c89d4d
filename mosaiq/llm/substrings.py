"""Removal of word passages that an earlier document has, by fixed-block anchors.

Reference side: each document's non-overlapping blocks of BLOCK words. Probe side: every rolling
window of BLOCK words. A passage of 2 * BLOCK - 1 words or more that two documents share covers a
whole block of either, so its windows hit. A block and a window can only be equal if the least
hash of their GRAM-word runs is, and neighbouring windows share it; so blocks are posted, and
windows probe, under that value, at about a ninth of the traffic and with no window left out.
Hits are then extended: every passage-long window around a hit is compared, by a 96-bit hash, with
those of all documents, and the windows found earlier merge to the maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .common import Words, mix, window_hashes
from .exchange import ASK, ASKED, answer, ask, bundle, decode_table, find, group_starts, with_answers

GRAM = 8
SEEDS = {"gram": 11, "low": 23, "high": 37}
NOBODY = np.iinfo(np.int64).max


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


class Passages:
    """The windows of a bundle's documents. Null ids take no part, as if their texts had no word."""

    def __init__(self, rows: pa.RecordBatch, passage: int):
        self.words = Words(rows.column(1))
        ids = rows.column(0)
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
        self.hashes = self.words.hashes()
        self.text = self.words.text_of_word()
        self.passage, self.block = passage, (passage + 1) // 2

    def starts(self, width: int) -> np.ndarray:
        """For each window of width words by its first word: whether it lies in one known document."""
        n = max(0, self.words.count - width + 1)
        return (self.text[:n] == self.text[width - 1 : width - 1 + n]) & self.known[self.text[:n]] if n else np.zeros(0, dtype=bool)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each rolling block window: the least gram hash, whether it counts, whether it is one of the fixed blocks."""
        whole = self.starts(self.block)
        # Least hashes are small numbers; mixing spreads them over the whole range and keeps them distinct.
        least = mix(least_of(window_hashes(self.hashes, GRAM, SEEDS["gram"]), self.block - GRAM + 1)[: len(whole)])
        fixed = (np.arange(len(whole)) - self.words.first[:-1][self.text[: len(whole)]]) % self.block == 0
        return least, whole, fixed

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        low = window_hashes(self.hashes, self.passage, SEEDS["low"])
        return low, (window_hashes(mix(self.hashes), self.passage, SEEDS["high"]) >> np.uint64(32)).astype(np.uint32)


def _post_and_probe(passage: int, fan: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bid, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                p = Passages(decode_table(payload.as_py()), passage)
                least, whole, fixed = p.anchors()
                # One probe for each stretch of windows with the same value in the same document.
                turn = group_starts(least, p.text[: len(least)]) | fixed
                pick = np.flatnonzero(turn & whole)
                value, doc, block = least[pick], p.ids[p.text[pick]], fixed[pick]
                order = np.lexsort((doc, value))
                value, doc, block = value[order], doc[order], block[order]
                at = np.flatnonzero(group_starts(value))
                if len(at):
                    several = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
                    flags = np.logical_or.reduceat(block, at).astype(np.uint8) | several.astype(np.uint8) << 1
                    yield ask(bid, value[at], [flags], fan)

    return run


def _join_flags(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ascending distinct values, and whether a block is posted under each (1) and more than one document has it (2)."""
    order = np.argsort(keys, kind="stable")
    at = np.flatnonzero(group_starts(keys[order]))
    if not len(at):
        return keys, columns
    flags, size = np.bitwise_or.reduceat(columns[0][order], at), np.diff(np.append(at, len(keys)))
    return keys[order][at], [flags | ((size > 1) << 1).astype(np.uint8)]


def _hit(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Values under which a block is posted and that more than one document has."""
    values, (flags,) = _join_flags(keys, columns)
    return (flags == 3)[find(keys, values)[1]] if len(values) else np.zeros(0, dtype=bool), []


def _extend(passage: int, fan: int):
    def run(bid: int, rows: pa.RecordBatch | None, hits: np.ndarray, _: list[np.ndarray]) -> pa.Table:
        empty = ASK.empty_table()
        if not len(hits):
            return empty
        p = Passages(rows, passage)
        least, whole, _ = p.anchors()
        hit = np.zeros(p.words.count + 1, dtype=np.int64)
        hit[1 : len(whole) + 1] = find(least, hits)[0] & whole
        seen = np.cumsum(hit)
        start = p.starts(passage)
        first = np.flatnonzero(start)
        # A passage at i holds the block windows that start at i to i + passage - block.
        first = first[seen[first + passage - p.block + 1] > seen[first]]
        low, high = (k[first] for k in p.keys())
        doc = p.ids[p.text[first]]
        order = np.lexsort((high, low))
        low, high, doc = low[order], high[order], doc[order]
        at = np.flatnonzero(group_starts(low, high))
        if not len(at):
            return empty
        return pa.Table.from_batches([ask(bid, low[at], [high[at], np.minimum.reduceat(doc, at), np.maximum.reduceat(doc, at)], fan)])

    return run


def _join_owners(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct passages with the smallest and the largest document that has each."""
    high, least, most = columns
    order = np.lexsort((high, keys))
    at = np.flatnonzero(group_starts(keys[order], high[order]))
    if not len(at):
        return keys, columns
    return keys[order][at], [high[order][at], np.minimum.reduceat(least[order], at), np.maximum.reduceat(most[order], at)]


def _first_owner(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The smallest document that has the passage, for askers with a larger one."""
    high, least, most = columns
    order = np.lexsort((high, keys))
    at = np.flatnonzero(group_starts(keys[order], high[order]))
    if not len(at):
        return np.zeros(0, dtype=bool), [high, least]
    owner = np.empty(len(keys), dtype=np.int64)
    owner[order] = np.repeat(np.minimum.reduceat(least[order], at), np.diff(np.append(at, len(keys))))
    return owner < most, [high, owner]


def _cut(passage: int, carry: list[str], schema: pa.Schema, keep_layout: bool):
    def run(bid: int, rows: pa.RecordBatch | None, low: np.ndarray, columns: list[np.ndarray]) -> pa.Table:
        if rows is None:
            return schema.empty_table()
        p = Passages(rows, passage)
        gone = np.zeros(p.words.count, dtype=bool)
        if len(low):
            high, owner = columns
            order = np.lexsort((high, low))
            low, high, owner = low[order], high[order], owner[order]
            mine, check = p.keys()
            doc = p.ids[p.text[: len(mine)]]
            # Ties of the first 64 bits are rare and stand together; look at each in turn.
            found, at = find(mine, low)
            repeat = np.zeros(len(mine), dtype=bool)
            for step in range(1 + int(np.diff(np.append(np.flatnonzero(group_starts(low)), len(low))).max())):
                there = np.minimum(at + step, len(low) - 1)
                repeat |= found & (low[there] == mine) & (high[there] == check) & (owner[there] < doc)
            repeat &= p.starts(passage)
            edge = np.zeros(p.words.count + 1, dtype=np.int64)
            edge[: len(repeat)] += repeat
            edge[passage : passage + len(repeat)] -= repeat
            gone = np.cumsum(edge)[:-1] > 0
        first, kept, spans = p.words.first, [], []
        removed = np.concatenate([[0], np.cumsum(gone)])
        removed = removed[first[1:]] - removed[first[:-1]]
        for i, text in enumerate(rows.column(1).to_pylist()):
            runs: list[dict] = []
            if keep_layout and not removed[i]:
                kept.append(None if text is None else text.encode())
                spans.append(runs)
                continue
            words = (text or "").encode().split()
            if removed[i]:
                mask = gone[first[i] : first[i + 1]]
                change = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                runs = [{"begin": int(a), "end": int(b)} for a, b in zip(change[::2], change[1::2], strict=True)]
                words = [w for w, g in zip(words, mask.tolist(), strict=True) if not g]
            kept.append(b" ".join(words))
            spans.append(runs)
        made = [rows.column(0).cast(pa.int64()), pa.array(np.diff(first)), pa.array(removed), pa.array(spans, schema.field("removed").type), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.Table.from_arrays([*made, *(rows.column(2 + i) for i in range(len(carry)))], schema=schema)

    return run


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", passage: int = 50, carry: list[str] | None = None, keep_layout: bool = False) -> DataFrame:
    """Remove each word covered by a passage-long window that also starts in a document with a smaller id.

    One row per row of docs: doc_id, n_words, n_removed, removed (word spans, end exclusive),
    kept_text (kept words joined by a space; with keep_layout, a text that loses nothing, or is null, stays as
    it is), then the columns named in carry, unchanged. Windows are judged on the input. Null text has no words. Rows with the same id are one another's
    equals, so neither removes from the other. Rows without an id neither lose words nor make
    others lose any. Other columns are ignored; an empty table gives an empty result. One
    document must fit a worker's memory some twenty times over.
    """
    if passage < 2 * GRAM:
        raise ValueError(f"passage must be {2 * GRAM} words or more")
    carry = carry or []
    bundles = bundle(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"carried {c}") for c in carry)), "text", "substring-bundles")
    count = bundles.count()
    hits = answer(bundles.mapInArrow(_post_and_probe(passage, exchange.FAN), ASKED), count, ["u1"], _join_flags, _hit, [])
    owners = answer(with_answers(bundles, hits, [], _extend(passage, exchange.FAN), ASKED), count, ["u4", "i8", "i8"], _join_owners, _first_owner, ["u4", "i8"])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema) if carry else ""
    schema = "doc_id long, n_words long, n_removed long, removed array<struct<begin: long, end: long>>, kept_text string" + (f", {kinds}" if kinds else "")
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)
    return with_answers(bundles, owners, ["u4", "i8"], _cut(passage, carry, arrow, keep_layout), schema)
