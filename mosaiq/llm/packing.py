"""Packing by concatenation: two passes of prefix sums give every document its global offset, and windows cut it.

Pass one tokenizes each partition once and writes ids with running offsets. The partition totals
(one row per input partition) are summed up, and pass two cuts at the window limits; nothing is
shuffled but the totals.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, prepare, release_memory, slices

_VISIBLE = np.zeros(256, dtype=bool)
_VISIBLE[0x21:0x7F] = True
_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_SIGN = _VISIBLE & ~_LETTER
_SIGN[0x30:0x3A] = False

#: Text bytes encoded at once. Distinct pieces are fewer the more text they come from.
ENCODE_BYTES = 8 << 20
JOINED = 400


class Encoder:
    """Byte-level BPE over pieces that the pre-tokenizer can't join, each distinct piece encoded once.

    A text may be cut where a visible ASCII character is followed by ASCII white space, and where
    an ASCII letter is followed by an ASCII sign: no pre-token crosses such a place, and its white
    space rule looks ahead no further than the same piece. Pieces that begin with white space and
    end visibly are encoded many in one string, and told apart by the bytes that each id stands
    for. Texts with a special token's string are encoded as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        # In byte-level vocabularies, each character of a token stands for one byte.
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.width[list(vocabulary.values())] = [len(t) for t in vocabulary]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def batch(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def pieces(self, distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after another, and the limits of each piece in them."""
        joins = np.fromiter((_GAP[p[0]] and _VISIBLE[p[-1]] for p in distinct), bool, len(distinct))
        order = np.concatenate([np.flatnonzero(joins), np.flatnonzero(~joins)])
        many, n = [distinct[i] for i in order], int(joins.sum())
        strings = [b"".join(many[i : min(i + JOINED, n)]) for i in range(0, n, JOINED)]
        # A few at a time: the library's own results take far more room than the ids.
        parts = [np.array(ids, dtype=np.uint32) for i in range(0, len(strings), 32) for ids in self.batch(strings[i : i + 32])]
        joined = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        alone = [np.array(ids, dtype=np.uint32) for i in range(n, len(many), 4096) for ids in self.batch(many[i : i + 4096])]
        ids = np.concatenate([joined, *alone])
        ends = np.cumsum([len(p) for p in many[:n]])
        limits = np.searchsorted(np.cumsum(self.width[ids[: len(joined)]]), ends) + 1
        limits = np.concatenate([[0], limits, len(joined) + np.cumsum([len(x) for x in alone])]).astype(np.int64)
        starts, counts = np.empty(len(distinct), np.int64), np.empty(len(distinct), np.int64)
        starts[order], counts[order] = limits[:-1], np.diff(limits)
        return ids, np.stack([starts, counts])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        texts = texts.cast(pa.large_string()).fill_null("")
        limits = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[limits[0] : limits[-1]] if raw is not None else np.zeros(0, np.uint8)
        limits = limits - limits[0]
        cut = np.zeros(len(data) + 1, dtype=bool)
        if len(data):
            cut[1:-1] = _VISIBLE[data[:-1]] & _GAP[data[1:]] | _LETTER[data[:-1]] & _SIGN[data[1:]]
        cut[limits] = True
        at = np.flatnonzero(cut).astype(np.int32)
        if len(at) < 2:
            return [np.zeros(0, np.uint32) for _ in limits[1:]]
        coded = pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
        flat, (starts, counts) = self.pieces(coded.dictionary.to_pylist())
        codes = coded.indices.to_numpy()
        each = counts[codes]
        ends = np.concatenate([[0], np.cumsum(each)])
        out = flat[np.repeat(starts[codes] - ends[:-1], each) + np.arange(ends[-1])]
        bounds = ends[np.searchsorted(at, limits)]
        special = np.zeros(len(texts), dtype=bool)
        for s in self.special:
            special |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        return [self.whole(texts[i].as_py()) if special[i] else out[bounds[i] : bounds[i + 1]] for i in range(len(texts))]


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, end_id: int = 0, checksums: bool = False) -> DataFrame:
    """Pieces of all documents in sequences of exactly window tokens, the last one perhaps shorter.

    One row per piece: doc_id, start, length, ids (array), doc_tokens, sequence_id, offset. With
    checksums, ids_crc32 takes the place of ids: the crc32 of the ids as little-endian unsigned
    32-bit numbers. A document's ids end with end_id, so an empty or null text still has one.
    Order is that of the input's partitions. Repeated rows are packed as often as they come; null
    ids are kept; extra columns are ignored; an empty table gives no piece. tokenizer is a local
    path that every executor has, as an installed vocabulary file is.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, total = Encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text", ENCODE_BYTES):
            rows = [np.append(x, np.uint32(end_id)).astype("<u4") for x in encoder.encode(batch.column(1))]
            counts = np.array([len(x) for x in rows], dtype=np.int64)
            before = total + np.cumsum(counts) - counts
            total += int(counts.sum())
            # Two bytes an id where the vocabulary allows.
            packed = [x.astype("<u2").tobytes() if x.max() < 1 << 16 else x.tobytes() for x in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(np.full(len(rows), part)), pa.array(before), pa.array(counts), pa.array(packed, pa.binary())], ["doc_id", "part", "before", "doc_tokens", "ids"])
            del rows, packed
        release_memory()

    prepare(docs.sparkSession)
    encoded = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, "doc_id long, part long, before long, doc_tokens long, ids binary"), "pack-ids")
    totals = encoded.groupBy("part").agg(F.sum("doc_tokens").alias("tokens"))
    bases = materialize(totals.select("part", F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")), "pack-bases")
    content = ("ids_crc32", pa.int64(), "long") if checksums else ("ids", pa.list_(pa.int32()), "array<int>")
    fields = [("doc_id", pa.int64(), "long"), ("start", pa.int64(), "long"), ("length", pa.int64(), "long"), content, ("doc_tokens", pa.int64(), "long"), ("sequence_id", pa.int64(), "long"), ("offset", pa.int64(), "long")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids"):
            out: list[tuple] = []
            for doc, begin, count, blob in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ids = np.frombuffer(blob, "<u4" if len(blob) == 4 * count else "<u2").astype("<i4")
                edges = [0, *range(window - begin % window, count, window), count]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    out.append((doc, a, b - a, zlib.crc32(ids[a:b].tobytes()) if checksums else ids[a:b], count, (begin + a) // window, (begin + a) % window))
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind, _) in zip(columns, fields, strict=True)], [name for name, _, _ in fields])
        release_memory()

    placed = encoded.join(bases, "part").select("doc_id", (F.col("base") + F.col("before")).alias("begin"), "doc_tokens", "ids")
    return placed.mapInArrow(cut, ", ".join(f"{name} {kind}" for name, _, kind in fields))
