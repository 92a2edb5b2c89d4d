"""Helpers shared by the training-data operators: scratch tables, folds and vectorised word kernels.

Words are maximal runs of bytes other than space and 0x09-0x0D, which is what ``bytes.split()``
cuts at, so one definition serves SQL (:data:`WORD`), plain Python and the kernels below.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.session import ship_package

#: A word, for Java's, DuckDB's and Python's regular expressions alike.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

_IS_GAP = np.zeros(256, dtype=bool)
_IS_GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Text bytes that a kernel handles at once; its scratch arrays take some twenty times as much.
CHUNK_BYTES = 4 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); one of our own only where it is unset and Spark is one local process, as in tests."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.mosaiq.scratch", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="mosaiq-")
        spark.conf.set("spark.mosaiq.scratch", path)
    return path.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared scratch folder and read it back.

    This cuts lineage at a table which survives lost executors, fixes what is not repeatable
    (row ids, batch limits), and gives the optimizer a real size to choose its joins by. The
    tables live until discard(), or as long as the folder's owner keeps them.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/mosaiq-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Scratch tables of this process that are not discarded, oldest first.
_written: list[str] = []


def tables_written() -> int:
    """A mark for discard()."""
    return len(_written)


def discard(spark: SparkSession, since: int, keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete the scratch tables written after the mark, but for those in keep; nothing that is still to run may read them.

    Shuffle files that no plan refers to any longer go too, as soon as Spark learns of it.
    """
    held = {f for df in keep for f in df.inputFiles()}
    jvm = spark.sparkContext._jvm
    for path in _written[since:]:
        if not any(path.rsplit("/", 1)[-1] in f for f in held):
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
            _written.remove(path)
    for _ in range(2):  # what the first round finds is let go of a little later
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.1)


def prepare(spark: SparkSession, rows: int = 2500) -> None:
    """Ready the session for Python functions: ship the package, and send at most so many rows to a worker at once.

    A batch of whole texts must stay far below a worker's memory.
    """
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def fold(key: str | Column, parts: int) -> Column:
    """crc32 of the key as text, modulo parts; null for a null key."""
    return F.crc32((F.col(key) if isinstance(key, str) else key).cast("string").cast("binary")) % parts


def rows_kept(rows: DataFrame, verdicts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows whose verdict (doc_id, text_hash, kept) is to keep them; text_hash is the xxhash64 of the text, "" for null.

    An id alone says who goes, unless rows share it and differ, or it is null: then the text tells.
    """
    verdicts = materialize(verdicts.select("doc_id", "text_hash", "kept"), "verdicts")
    ids = verdicts.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("kept").alias("some"), F.min("kept").alias("every"))
    gone = materialize(ids.where("NOT some").select(F.col("doc_id").alias("bad id")), "rejected")
    unclear = verdicts.where("NOT kept").join(ids.where("some AND NOT every").select("doc_id"), "doc_id", "left_semi").unionByName(verdicts.where("NOT kept AND doc_id IS NULL"))
    bad = materialize(unclear.select(F.col("doc_id").alias("bad id"), F.col("text_hash").alias("bad hash")).distinct(), "unclear")
    rest = rows.join(gone, rows[id_col] == gone["bad id"], "left_anti")
    if bad.isEmpty():
        return rest
    return rest.join(bad, rest[id_col].eqNullSafe(bad["bad id"]) & (F.xxhash64(F.coalesce(rest[text_col], F.lit(""))) == bad["bad hash"]), "left_anti")


def words_column(text: Column) -> Column:
    """The words of a text as an array; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def release_memory() -> None:
    """Give freed memory back to the system, as a worker process lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


# --- Arrow side -------------------------------------------------------------------------------


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about limit bytes of text, or one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(ends):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


class Words:
    """All words of a column of texts, as flat arrays.

    first: for text i, its words are first[i]:first[i+1]. codes: each word's place in
    dictionary, a list of distinct byte strings.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        inside = ~_IS_GAP[data]
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        begins[cuts] = inside[cuts]
        stops[cuts - 1] = inside[cuts - 1]
        start, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(start, offsets)
        self.count = len(start)
        packed = data[inside]
        ends = np.zeros(len(start) + 1, np.int32)
        np.cumsum(stop - start, out=ends[1:])
        if lower:
            packed = _LOWER[packed]
        #: The bytes of all words one after another, and where each word ends in them (a leading 0 included).
        self.packed, self.ends = packed, ends
        flat = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(packed)])
        coded = flat.dictionary_encode()
        self.codes = coded.indices.to_numpy()
        self.dictionary = coded.dictionary.to_pylist()

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def distinct_hashes(self) -> np.ndarray:
        """A 64-bit hash of each entry of the dictionary."""
        return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.dictionary), np.uint64, len(self.dictionary))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        distinct = self.distinct_hashes()
        return distinct[self.codes] if len(distinct) else np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def odd_numbers(count: int, seed: int) -> np.ndarray:
    """count odd 64-bit multipliers derived from seed."""
    return mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def window_hashes(words: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A hash of each run of width consecutive entries of words (len(words) - width + 1 of them), ignoring text limits."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if width <= 8:
        out = np.zeros(n, np.uint64)
        for k, by in enumerate(odd_numbers(width, seed)):
            out += words[k : k + n] * by
        return mix(out)
    # Prefix sums of words[i] * b**i; dividing by b**i makes equal runs equal wherever they stand.
    base = int(odd_numbers(1, seed)[0]) | 5
    inverse = pow(base, -1, 1 << 64)
    up = np.full(len(words), base, np.uint64)
    down = np.full(len(words), inverse, np.uint64)
    up[0] = down[0] = 1
    np.multiply.accumulate(up, out=up)
    np.multiply.accumulate(down, out=down)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words + np.uint64(seed)) * up, out=total[1:])
    return mix((total[width:] - total[:-width]) * down[:n])
