"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter n-gram is the product of its letters'
vectors, each permuted by its place; a text is the sum (bundle) of its n-grams, and a language's
prototype the sum of its texts' unit vectors. A text's language is the prototype with the highest
cosine, after the prototypes' common part is taken out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, prepare, release_memory, slices

DIMENSIONS = 1024
GRAM = 3
#: Unit vectors are summed as whole numbers, so that the order of summing can't matter.
UNIT = 1 << 20
#: How sharply cosines turn into a score.
SHARPNESS = 12.0
CHUNK = 1 << 20

_LETTERS: np.ndarray | None = None


def letter_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in lower case, 0 where no letter stands, and the text limits; each text ends with a 0."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    parts = [np.frombuffer((t or "").lower().encode("utf-32-le", "replace"), np.uint32) for t in texts.to_pylist()]
    limits = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
    flat = np.zeros(limits[-1], np.uint32)
    for p, at in zip(parts, limits[:-1], strict=True):
        flat[at : at + len(p)] = p
    return np.where(_LETTERS[flat], flat, 0), limits


def letter_vectors(codes: np.ndarray) -> np.ndarray:
    """One row of +1 and -1 for each code point, from the code point alone; the word limit 0 has one too."""
    words = mix((codes.astype(np.uint64)[:, None] << np.uint64(16)) + np.arange(DIMENSIONS // 64, dtype=np.uint64) + np.uint64(1 << 60))
    bits = np.unpackbits(words.view(np.uint8).reshape(len(codes), -1), axis=1)
    return (2 * bits.astype(np.int8) - 1)[:, :DIMENSIONS]


def text_vectors(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A bundle for each text, and which texts have a letter."""
    codes, limits = letter_codes(texts)
    lettered = np.add.reduceat(codes > 0, limits[:-1]) > 0 if len(codes) else np.zeros(0, bool)
    text = np.repeat(np.arange(len(limits) - 1), np.diff(limits))
    alphabet, place = np.unique(codes, return_inverse=True)
    # A gram starts at a word's first letter or the limit before it, and holds a letter.
    padded = np.concatenate([np.zeros(1, place.dtype), place])  # code 0 comes first in the alphabet
    n = len(place)
    grams = np.zeros(max(0, n - GRAM + 2), np.int64)
    held = np.zeros(len(grams), dtype=bool)
    whole = np.concatenate([[0], codes])
    for k in range(GRAM):
        grams = grams * len(alphabet) + padded[k : k + len(grams)]
        held |= whole[k : k + len(grams)] > 0
    middle = np.minimum(np.arange(len(grams)), n - 1)
    last = np.minimum(middle + GRAM - 2, n - 1)
    held &= (text[middle] == text[last]) & ~((whole[1 : 1 + len(grams)] == 0))
    grams, owner = grams[held], text[middle[held]]
    kinds, index = np.unique(grams, return_inverse=True)
    vectors = letter_vectors(alphabet)
    bound = np.ones((len(kinds), DIMENSIONS), np.int8)
    rest = kinds.copy()
    for k in range(GRAM - 1, -1, -1):
        bound *= np.roll(vectors[rest % len(alphabet)], GRAM - 1 - k, axis=1)
        rest //= len(alphabet)
    out = np.zeros((len(limits) - 1, DIMENSIONS), np.float32)
    step = max(1, (24 << 20) // (4 * max(1, len(out))))
    order = np.argsort(index, kind="stable")
    index, owner = index[order], owner[order]
    for low in range(0, len(kinds), step):
        a, b = np.searchsorted(index, [low, low + step])
        width = min(step, len(kinds) - low)
        counts = np.bincount(owner[a:b] * width + index[a:b] - low, minlength=len(out) * width).reshape(len(out), width).astype(np.float32)
        out += counts @ bound[low : low + width].astype(np.float32)
    return out, lettered


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=-1, keepdims=True)), 1e-12)


def learn(docs: DataFrame, text_col: str, lang_col: str) -> tuple[list[str], np.ndarray]:
    """Prototypes (languages, unit rows) from all rows of docs with a language; a sum of DIMENSIONS numbers per language."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text", CHUNK):
            vectors, lettered = text_vectors(batch.column(0))
            units = np.rint(_unit(vectors) * UNIT).astype(np.int64)
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for lang in set(langs[lettered]):
                total[lang] = total.get(lang, 0) + units[lettered & (langs == lang)].sum(axis=0)
        release_memory()
        for lang, row in total.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang], "row": pa.array([row], pa.list_(pa.int64()))})

    parts = docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).mapInArrow(sums, "lang string, row array<long>")
    rows = parts.select("lang", F.posexplode("row").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x")).orderBy("lang", "at").collect()
    langs = sorted({r["lang"] for r in rows})
    found = np.zeros((len(langs), DIMENSIONS))
    for r in rows:
        found[langs.index(r["lang"]), r["at"]] = r["x"]
    return langs, _unit(found)


def identify(docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, the columns in keep, lang_pred and score (0 to 1) for each row of docs.

    Prototypes are learned from the rows where train holds and the language is not null. Texts
    that are null or have no letter get "und" and score 0, as all do if nothing was learned; ties
    go to the language that sorts first. Null and repeated ids are rows like others; an empty
    table gives an empty result. Languages are collected to the driver: some thousand at most.
    """
    prepare(docs.sparkSession)
    langs, prototypes = learn(docs.where(train), text_col, lang_col)
    common = prototypes.mean(axis=0) if len(langs) > 1 else np.zeros(DIMENSIONS)
    centred = _unit(prototypes - common)
    kept = list(keep or {})

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", CHUNK):
            vectors, lettered = text_vectors(batch.column(1))
            names, scores = ["und"] * len(lettered), np.zeros(len(lettered))
            if langs:
                cosines = _unit(_unit(vectors) - common) @ centred.T
                weight = np.exp(SHARPNESS * (cosines - cosines.max(axis=1, keepdims=True)))
                top = cosines.argmax(axis=1)
                names = [langs[i] if ok else "und" for i, ok in zip(top, lettered, strict=True)]
                scores = np.where(lettered, weight.max(axis=1) / weight.sum(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(names, pa.string()), pa.array(scores)], ["doc_id", *kept, "lang_pred", "score"])
        release_memory()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *(c.alias(n) for n, c in (keep or {}).items()))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(predict, f"{kinds}, lang_pred string, score double")
