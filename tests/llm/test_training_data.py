import math
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mosaiq.llm import common, components, exchange, language, language_model, licenses, mixing, near_duplicates, packing, quality_classifier, quality_rules, queries, seating, sql, substrings, top_k
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, score string, kept string"
LONG = " ".join(f"w{i}" for i in range(300))


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, None, "clash", "clash", "clash") for d, t, s in rows], SCHEMA)


def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, white space of several kinds."""
    return [
        (1, LONG, "a"), (2, LONG, "a"), (2, LONG, "a"), (3, None, None), (4, "", "a"), (5, " \t\n ", "b"), (6, "one two three", "b"), (7, "ONE two\x0bthree", ""),
        (8, LONG + " tail", "a"), (9, "x " + LONG.replace("w150", "q"), "b"), (10, "é ü ß \U0001f600 " * 30, "b"), (None, LONG, "a"), (11, "big " * 60_000, "c"), (12, "one two three four five six", None),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, odd_rows())


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, odd_rows()).where("doc_id = -1")


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def plain(documents):
    return [(r["doc_id"], r["text"]) for r in documents.collect()]


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_query_equals_sql(same, name):
    same(queries.QUERIES[name], sql.ORACLES[name])


# --- kernels ---


def test_words_are_those_of_the_pattern():
    texts = ["a b", "", "  x\x0by z ", "tail\n", "\x1c\x1d w"]
    words = common.Words(pa.array([*texts, None]))
    got = [[words.dictionary[c].decode() for c in words.codes[a:b]] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
    assert got == [brute.words(t) for t in texts] + [[]]


def test_sliced_arrays_keep_their_words():
    whole = pa.array(["aa bb", "cc", "dd ee"])
    words = common.Words(whole.slice(1, 2))
    assert [words.dictionary[c] for c in words.codes] == [b"cc", b"dd", b"ee"]


@pytest.mark.parametrize("width", [3, 8, 9, 50])
def test_window_hashes_depend_on_content_only(width):
    values = common.mix(np.arange(40, dtype=np.uint64))
    twice = np.concatenate([values, np.arange(7, dtype=np.uint64), values])
    made = common.window_hashes(np.tile(twice, 3), width, 1)
    shift = len(twice)
    assert (made[: len(made) - shift] == made[shift:]).all()
    if width <= 40:
        assert made[0] == made[47] and made[1] != made[0]


def test_slots_refine(spark):
    values = common.mix(np.arange(5000, dtype=np.uint64))
    for slots in (48, 48**2):
        assert (exchange.slot_of(values, slots * 48) // 48 == exchange.slot_of(values, slots)).all()
    numbers = np.arange(1, 3000, dtype=np.uint64)
    for slots in (48, 48**2):
        assert (exchange.slot_of(language_model.by_slot(slots)(numbers), slots) == (numbers.astype(np.int64) - 1) % slots).all()
    keys = np.sort(values)
    columns = [np.arange(5000, dtype=np.int64) - 7, np.arange(5000, dtype=np.uint8)]
    got = exchange.unpack([exchange.pack_keys(keys)], [exchange.pack_columns(columns)], ["i8", "u1"])
    assert (got[0] == keys).all() and all((a == b).all() for a, b in zip(got[1], columns, strict=True)) and got[2].tolist() == [5000]


@pytest.mark.parametrize("count", [3, 40])
def test_rows_of_an_exchange_are_in_proportion_to_bundles(spark, monkeypatch, count):
    """Past several levels of groups, each bundle still writes FAN rows, each group FAN more, and the answers are the same."""
    monkeypatch.setattr(exchange, "FAN", 4)
    monkeypatch.setattr(exchange, "PER_BUCKET", 1)
    rng = np.random.default_rng(count)
    held = [np.unique(common.mix(rng.integers(0, 400, 150, dtype=np.uint64))) for _ in range(count)]
    bundles = spark.createDataFrame([(i, k.tobytes()) for i, k in enumerate(held)], "bid long, payload binary")

    def questions(batches):
        for batch in batches:
            for bid, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys = np.frombuffer(blob, np.uint64)
                yield exchange.ask(bid, keys, [np.ones(len(keys), np.int64)], 4)

    asked = common.materialize(bundles.mapInArrow(questions, exchange.ASKED), "asked")
    written, real = [asked], exchange.materialize
    monkeypatch.setattr(exchange, "materialize", lambda df, label: written.append(real(df, label)) or written[-1])
    common.prepare(spark)

    def decide(keys, columns):
        values, (total,) = language_model._added(keys, columns)
        often = total[np.searchsorted(values, keys)]
        return often > 1, [often]

    answers = exchange.answer(asked, count, ["i8"], language_model._added, decide, ["i8"]).collect()
    assert exchange.levels_for(count) == len(written) if count > 4 else len(written) == 1
    assert all(df.count() <= 4 * count for df in written)
    total = Counter(int(k) for keys in held for k in keys)
    got = defaultdict(dict)
    for r in answers:
        keys, (often,), _ = exchange.unpack([r["keys"]], [r["extra"]], ["i8"])
        got[r["bid"]].update(zip(keys.tolist(), often.tolist(), strict=True))
    for i, keys in enumerate(held):
        assert got[i] == {int(k): total[int(k)] for k in keys if total[int(k)] > 1}


# --- substring dedup ---


def test_repeats_equal_brute_force(documents, plain):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["h"]) for r in substrings.remove_repeats(documents).select("*", F.sha2(F.col("kept_text").cast("binary"), 256).alias("h")).collect()}
    assert got == {d: tuple(rest) for d, *rest in brute.repeats(plain)}


@pytest.mark.parametrize("passage", [16, 50, 51])
def test_repeats_of_odd_rows(odd, passage):
    rows = [(d, t) for d, t, _ in odd_rows()]
    made = substrings.remove_repeats(odd, passage=passage, carry=["source"]).select("*", F.sha2(F.col("kept_text").cast("binary"), 256).alias("h")).collect()
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["h"]) for r in made], key=key) == sorted(brute.repeats(rows, passage), key=key)
    for r in made:
        assert sum(s["end"] - s["begin"] for s in r["removed"]) == r["n_removed"]


def test_repeats_of_nothing(none):
    assert substrings.remove_repeats(none).count() == 0
    with pytest.raises(ValueError):
        substrings.remove_repeats(none, passage=3)


# --- near duplicates ---


def near_rows(df, **settings):
    return sorted([tuple(r) for r in near_duplicates.near_duplicates(df, **settings).select("doc_id", "n_shingles", "component_id", "kept").collect()], key=repr)


def test_near_duplicates_equal_brute_force(documents, plain):
    want = brute.near(plain)
    assert near_rows(documents) == sorted([(d, n, c, d == c) for d, (n, c) in want.items()], key=repr)


def test_near_duplicates_of_odd_rows(odd):
    rows = [(d, t) for d, t, _ in odd_rows()]
    want = brute.near(rows)
    assert near_rows(odd) == sorted([(d, len(brute.shingles(t)) if d is None else want[d][0], None if d is None else want[d][1], True if d is None else want[d][1] == d) for d, t in rows], key=repr)


def test_large_neighbourhood_is_compared_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for d in range(120):
        w = list(base)
        for at in rng.choice(80, rng.integers(0, 5), replace=False):
            w[at] = f"new{d}x{at}"
        rows.append((d, " ".join(w), "a"))
    monkeypatch.setattr(near_duplicates, "BLOCK", 32)
    want = brute.near([(d, t) for d, t, _ in rows])
    assert near_rows(frame(spark, rows)) == sorted([(d, n, c, d == c) for d, (n, c) in want.items()], key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_chained_groups_that_share_lists(spark, monkeypatch, seed):
    """Groups that share rare words and drift apart word by word: the first class of a list does not join them all."""
    rng = np.random.default_rng(seed)
    rows = []
    for group in range(4):
        w = [f"g{group % 2}w{i}" for i in range(120)]
        for d in range(40):
            at = int(rng.integers(0, 116))
            w[at : at + 2] = [f"n{group}x{d}", f"n{group}y{d}"]
            rows.append((group * 1000 + d, " ".join(w), "a"))
    monkeypatch.setattr(near_duplicates, "BLOCK", 8)
    monkeypatch.setattr(near_duplicates, "BLOCK_SHINGLES", 2000)
    want = brute.near([(d, t) for d, t, _ in rows])
    assert near_rows(frame(spark, rows)) == sorted([(d, n, c, d == c) for d, (n, c) in want.items()], key=repr)


def noisy_copies(copies):
    """Copies of a text with one to three words changed: all alike to a signature, few of them linked."""
    rng = np.random.default_rng(copies)
    rows = []
    for d in range(copies):
        w = [f"w{i}" for i in range(100)]
        for at in rng.choice(25, rng.integers(1, 4), replace=False) * 4:
            w[at] = f"new{d}x{at}"
        rows.append((d, " ".join(w), "a"))
    return rows


def test_classes_that_share_many_lists_are_compared_once(spark, monkeypatch):
    rows, made = noisy_copies(150), {}

    def counted(df, label, materialize=common.materialize):
        out = materialize(df, label)
        made[label] = made.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(near_duplicates, "materialize", counted)
    want = brute.near([(d, t) for d, t, _ in rows])
    assert 20 < len({c for _, c in want.values()}) < 130
    assert near_rows(frame(spark, rows)) == sorted([(d, n, c, d == c) for d, (n, c) in want.items()], key=repr)
    assert 0 < made["near-close"] <= 12 * len(rows)


@pytest.mark.parametrize(("peers", "block"), [(7, 3), (40, 8), (4096, 512)])
def test_blocks_of_signatures_and_of_sets(spark, monkeypatch, peers, block):
    rows = noisy_copies(90) + [(1000 + d, " ".join(f"o{i}" for i in range(d % 7, 60 + d % 5)), "b") for d in range(40)]
    monkeypatch.setattr(near_duplicates, "PEERS", peers)
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    want = brute.near([(d, t) for d, t, _ in rows])
    assert near_rows(frame(spark, rows)) == sorted([(d, n, c, d == c) for d, (n, c) in want.items()], key=repr)


def test_lists_met_before():
    left, right = np.zeros((2, near_duplicates.COORDINATES), np.uint32), np.zeros((2, near_duplicates.COORDINATES), np.uint32)
    right[1, :10] = 1
    prefix = np.array([0b1000000100, 0b10000000000], np.uint64)
    met = lambda k: near_duplicates.met_before(left, right, prefix, np.full(2, (1 << 64) - 1, np.uint64), k).tolist()
    assert met(2) == [[False, False], [False, False]]
    assert met(3) == [[True, False], [False, False]]
    assert met(11) == [[True, False], [True, True]]


@pytest.mark.parametrize("classes", [1, 500, 9000])
def test_few_texts_are_moved_to_find_those_of_classes(spark, classes):
    rows = spark.range(60_000).select(F.when(F.col("id") != 16, F.col("id")).alias("doc_id"), F.xxhash64("id").alias("text_hash"))
    wanted = rows.where(f"doc_id % 6 = 5 AND doc_id < {6 * classes}").select(F.col("doc_id").alias("rep"), F.col("text_hash").alias("class_hash"))
    found = near_duplicates._likely(rows, wanted)
    assert found.columns == rows.columns
    assert found.join(wanted, (F.col("doc_id") == F.col("rep")) & (F.col("text_hash") == F.col("class_hash"))).count() == classes
    assert found.count() == found.distinct().count() < classes + 0.1 * 60_000


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    other = " ".join(f"o{i}" for i in range(200))
    rows = [(5, LONG, "a"), (5, other, "a"), (3, LONG + " x", "a"), (5, LONG + " y", "b"), (9, other, "a"), (9, other, "a"), (4, "", "a"), (4, "", "a"), (None, LONG, "a")]
    made = near_duplicates.near_duplicates(frame(spark, rows)).collect()
    assert Counter((r["doc_id"], r["component_id"], r["kept"]) for r in made) == Counter([(5, 3, False), (5, 5, True), (3, 3, True), (5, 3, False), (9, 5, False), (9, 5, False), (4, 4, True), (4, 4, True), (None, None, True)])
    left = near_duplicates.without_near_duplicates(frame(spark, rows))
    assert left.columns == frame(spark, rows).columns
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter([(5, other), (3, LONG + " x"), (4, ""), (4, ""), (None, LONG)])
    tied = [(7, LONG + " p", "a"), (7, LONG + " q", "a"), (7, LONG + " q", "b"), (8, LONG, "a")]
    assert near_duplicates.without_near_duplicates(frame(spark, tied)).count() == 1


def test_near_duplicates_of_nothing(none):
    assert near_rows(none) == []


def test_threshold_is_met_exactly():
    sets = [np.arange(0, 8, dtype=np.uint64), np.arange(0, 6, dtype=np.uint64), np.arange(1, 8, dtype=np.uint64)]
    close = np.triu(np.ones((3, 3), dtype=bool), 1)
    assert near_duplicates.confirmed(sets, close, Fraction(3, 4)).tolist() == [[False, True, True], [False, False, False], [False, False, False]]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (200, 200), (50, 40)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 1, 100: 100, 101: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- packing ---


def check_pack(rows, pieces, window=1024):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    want = Counter((d, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (0,)) for d, t in rows)
    docs, places = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p["length"] == len(p["ids"]) > 0
        docs[p["doc_id"]].append(p)
        places[p["sequence_id"]].append((p["offset"], p["length"]))
    made = Counter()
    for d, ps in docs.items():
        held = sorted(ps, key=lambda p: (p["sequence_id"], p["offset"]))
        ids = []
        for p in held:
            assert p["start"] == len(ids)
            ids += p["ids"]
            if len(ids) == p["doc_tokens"]:
                made[d, tuple(ids)] += 1
                ids = []
        assert not ids
    assert made == want
    for s, held in places.items():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at == window or s == max(places)


def test_packing_round_trip(documents, plain):
    check_pack(plain, packing.pack(documents, queries.tokenizer_path()).collect())


def test_packing_of_odd_rows(odd, none):
    rows = [(d, t) for d, t, _ in odd_rows()]
    check_pack(rows, packing.pack(odd, queries.tokenizer_path(), window=64).collect(), 64)
    assert packing.pack(none, queries.tokenizer_path()).count() == 0


def test_encoder_equals_the_tokenizer():
    encoder = packing.Encoder(queries.tokenizer_path())
    texts = ["", " ", "a  b\n\n c", "don't 'S x'y", "a \n\nb", "é!? über1,2\t\tx ", "<|endoftext|> a<|endoftext|>", "it's,it's;it's", "x\n \n y", "　\n z", "end.  next"]
    for t, ids in zip(texts, encoder.encode(pa.array(texts)), strict=True):
        assert ids.tolist() == encoder.whole(t).tolist(), t


def test_checksums(documents):
    ids = {(p["doc_id"], p["start"]): zlib.crc32(np.array(p["ids"], "<u4").tobytes()) for p in packing.pack(documents, queries.tokenizer_path()).collect()}
    got = {(p["doc_id"], p["start"]): p["ids_crc32"] for p in packing.pack(documents, queries.tokenizer_path(), checksums=True).collect()}
    assert got == ids


# --- mixing ---


def test_mixing_of_odd_rows(odd, none):
    made = mixing.mix_sources(odd, carry=["source"]).collect()
    sizes = Counter()
    for _, t, s in odd_rows():
        sizes[s] += len(brute.words(t))
    order = sorted((s for s in sizes if s is not None)) + [None]
    left, targets, budget = dict(zip(order, [3, 1, 2] * 2, strict=False)), {}, 1.5 * sum(sizes.values())
    while left:
        share = {s: budget * w / sum(left.values()) for s, w in left.items()}
        full = [s for s in share if share[s] > 2 * sizes[s]]
        if not full:
            targets |= share
            break
        for s in full:
            targets[s] = 2.0 * sizes[s]
            budget -= targets[s]
            del left[s]
    taken = Counter()
    for r in made:
        assert r["target"] == pytest.approx(targets[r["source"]]) and r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, target in targets.items():
        assert abs(taken[s] - target) <= 1
    assert mixing.mix_sources(none).count() == 0 and len(made) == len(odd_rows())
    again = mixing.mix_sources(odd.repartition(7), carry=["source"]).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, made))


def test_mixed_rows_hold_the_words_taken(odd):
    taken, held = Counter(), Counter()
    for r in mixing.mix_sources(odd.where("doc_id <> 2")).collect():
        taken[r["doc_id"]] += r["taken"]
    for r in mixing.mixed_rows(odd.where("doc_id <> 2"), ["doc_id", "text", "lang", "source", "n_chars"]).collect():
        held[r["doc_id"]] += len(brute.words(r["text"]))
    assert +held == +taken


# --- quality rules ---


def test_quality_rules_of_odd_rows(odd, none):
    made = sorted(quality_rules.quality_rules(odd).collect(), key=lambda r: repr((r["doc_id"], r["n_words"])))
    for r, (d, t) in zip(made, sorted(((d, t) for d, t, _ in odd_rows()), key=lambda x: repr((x[0], len(brute.words(x[1]))))), strict=True):
        w = brute.words(t)
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {i + k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in (t or "").split("\n") if brute.words(x)]
        assert (r["doc_id"], r["n_words"], r["n_repeat_words"], r["word_chars"]) == (d, len(w), len(covered), sum(map(len, w)))
        assert r["n_dup_lines"] == len(lines) - len(set(lines)) and r["n_symbols"] == sum(c in "#*$%&|<>" for c in t or "")
    assert quality_rules.quality_rules(none).count() == 0


def test_frequent_lines_deplete(spark):
    line = "this line is on many pages of the host and says nothing new at all to anyone who reads it again"
    few = lambda i: " ".join(f"{chr(97 + i % 3)}{chr(97 + k)}" for k in range(10))
    rows = [(i, f"{line}\n{few(i)}", "a") for i in range(40)] + [(100 + i, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)) + "\n" + line, "a") for i in range(40)]
    limits = quality_rules.LineLimits(least_documents=5, share_percent=10.0, keep_percent=60)
    made = {r["doc_id"]: r for r in quality_rules.quality_rules(frame(spark, rows), limits=limits).collect()}
    # The first forty have three different texts, so their second lines are on thirteen documents each.
    assert {(d < 100, r["removed_words"], r["base_failed"]) for d, r in made.items()} == {(True, 31, False), (False, 21, False)}
    assert {d for d, r in made.items() if r["kept"]} == set(range(100, 140))
    bounded = quality_rules.LineLimits(least_documents=5, share_percent=100.0, most_documents=30, keep_percent=60)
    assert {r["removed_words"] for r in quality_rules.quality_rules(frame(spark, rows), limits=bounded).collect()} == {21}


def test_copies_count_as_documents(spark):
    text = " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(40))
    rows = [(i, text, "a") for i in range(60)] + [(100 + i, text.replace("a", f"z{chr(97 + i)}"), "a") for i in range(5)]
    made = {r["doc_id"]: (r["removed_words"], r["kept"]) for r in quality_rules.quality_rules(frame(spark, rows)).collect()}
    assert made == {**{i: (40, False) for i in range(60)}, **{100 + i: (0, True) for i in range(5)}}


# --- classifiers ---


def test_quality_classifier_on_held_out_rows(spark, documents):
    sf = "/root/testdata/sf0.01"
    made = queries.op2_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    right = made.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.min("score"), F.max("score")).first()
    assert right[0] > 0.95 and 0 <= right[1] <= right[2] <= 1


def test_quality_classifier_of_odd_rows(spark, odd, none):
    empty = spark.createDataFrame([], "doc_id long, quality int")
    made = quality_classifier.classify(odd, empty, common.fold("doc_id", 3) == 1).collect()
    assert len(made) == len(odd_rows()) and {r["score"] for r in made} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, None), (6, 0), (None, 1)], "doc_id long, quality int")
    assert quality_classifier.classify(odd, one, common.fold("doc_id", 3) == 1).count() == len(odd_rows())
    assert quality_classifier.classify(none, one, common.fold("doc_id", 3) == 1).count() == 0


def test_rules_mean_the_same_in_spark(spark):
    rng = np.random.default_rng(2)
    x = rng.random((400, len(quality_classifier.STATISTICS)))
    y = ((x[:, 0] > 0.6) & (x[:, 3] <= 0.5)).astype(float)
    model = quality_classifier.fit(x, y)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in quality_classifier.STATISTICS))
    got = np.array([r[0] for r in df.select(model.column()).collect()])
    assert got == pytest.approx(1 / (1 + np.exp(-model.logit(x))), abs=1e-9)
    assert ((got >= 0.5) == (y > 0)).mean() > 0.97 and len(model.rules) < 120


def test_rule_scores_by_loops(spark, documents, monkeypatch):
    """Statistics and scores of all rows, computed plainly from the fitted rules."""
    fitted = []
    real = quality_classifier.fit
    monkeypatch.setattr(quality_classifier, "fit", lambda x, y: fitted.append(real(x, y)) or fitted[-1])
    made = {r["doc_id"]: r for r in queries.op2_quality_classifier(spark, "/root/testdata/sf0.001").collect()}
    columns = {r["doc_id"]: r for r in quality_classifier.statistics(documents, "doc_id", "text").collect()}
    assert fitted[0].rules
    for r in documents.collect():
        d, text, x = r["doc_id"], r["text"] or "", columns[r["doc_id"]]
        w = brute.words(text)
        lines = [y for y in text.split("\n") if y.strip(" ")]
        n, chars = max(len(w), 1), max(len(text), 1)
        share = lambda signs: sum(c in signs for c in text)  # noqa: E731, B023
        want = {
            "log_words": math.log1p(len(w)), "mean_word": sum(map(len, w)) / n, "longest_word": max(map(len, w), default=0), "symbol_share": share("#*$%&<>|") / chars,
            "upper_share": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / chars, "digit_share": share("0123456789") / chars, "sign_share": share("!?;:=@/\\_~^+\"'()[]{}-") / chars,
            "stop_share": share(".,") / n, "bar_share": share("|!") / n, "short_share": sum(len(y) <= 3 for y in w) / n, "distinct_share": len(set(w)) / n,
            "repeat_share": sum(a == b for a, b in zip(w, w[1:], strict=False)) / n, "ending_share": sum(y[-1] in ".!?" for y in w) / n,
            "dup_line_share": (len(lines) - len(set(lines))) / max(len(lines), 1), "line_words": len(w) / max(len(lines), 1),
        }
        assert {k: x[k] for k in want} == pytest.approx(want, abs=1e-9), d
        z = fitted[0].intercept
        for rule, weight in fitted[0].rules:
            if all((want[quality_classifier.STATISTICS[i]] > v) == above for i, above, v in rule.limits):
                z += weight
        score = 1 / (1 + math.exp(-z))
        assert made[d]["score"] == pytest.approx(score, abs=1e-9) and made[d]["predicted"] == (score >= 0.5)
        assert made[d]["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1)


def test_equal_texts_have_equal_quality_scores(spark, odd):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 13)], "doc_id long, quality int")
    scores = defaultdict(set)
    for r in quality_classifier.classify(odd, labels, F.lit(False)).collect():
        scores[r["doc_id"]].add(r["score"])
    assert scores[1] == scores[2] == scores[None] and scores[3] == scores[4] and all(len(x) == 1 for x in scores.values())


def test_language_profiles_by_loops(spark, documents):
    """Binding, bundling and cosines letter by letter."""
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in documents.collect()][:60]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    letters = {}

    def vector(c):
        if c not in letters:
            letters[c] = language.letter_vectors(np.array([ord(c) if c else 0], np.uint32))[0].astype(np.int64)
        return letters[c]

    def bundle(text):
        marks = [""] + [c if c.isalpha() else "" for c in (text or "").lower()] + [""]
        grams = Counter(g for g in zip(marks, marks[1:], marks[2:], strict=False) if g[1])
        out = np.zeros(language.DIMENSIONS)
        for gram, often in grams.items():
            bound = np.ones(language.DIMENSIONS, np.int64)
            for place, c in enumerate(gram):
                bound *= np.roll(vector(c), len(gram) - 1 - place)
            out += often * bound
        return out

    unit = lambda x: x / max(np.sqrt((x * x).sum(axis=-1)), 1e-12)
    bundles = {d: bundle(t) for d, t, _ in rows}
    langs = sorted({x for _, _, x in rows if x})
    sums = np.array([sum((np.rint(unit(bundles[d]) * language.UNIT) for d, t, x in rows if x == lang and d % 4 and any(map(str.isalpha, t or ""))), np.zeros(language.DIMENSIONS)) for lang in langs])
    prototypes = np.array([unit(x) for x in sums])
    common_part = prototypes.mean(axis=0)
    centred = np.array([unit(x - common_part) for x in prototypes])
    made = {r["doc_id"]: r for r in language.identify(docs, F.col("doc_id") % 4 != 0).collect()}
    for d, t, _ in rows:
        if not any(map(str.isalpha, t or "")):
            assert made[d]["lang_pred"] == "und"
            continue
        cosines = centred @ unit(unit(bundles[d]) - common_part)
        weight = np.exp(language.SHARPNESS * (cosines - cosines.max()))
        assert made[d]["lang_pred"] == langs[int(cosines.argmax())] and made[d]["score"] == pytest.approx(weight.max() / weight.sum(), abs=1e-4)


def test_language_ties_go_to_the_first(spark):
    docs = spark.createDataFrame([(1, "abc abc", "zz"), (2, "abc abc", "aa"), (3, "abc", None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language.identify(docs, F.lit(True)).collect()} == {"aa"}


def test_language_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    made = queries.op5_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").where("held_out")
    assert made.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.97


def test_language_of_odd_rows(odd, none):
    held = {"held_out": F.col("doc_id") == 6}
    made = language.identify(odd, F.col("doc_id") != 6, keep=held).collect()
    lettered = lambda t: any(c.isalpha() for c in t or "")
    want = Counter((d, "en" if lettered(t) else "und") for d, t, _ in odd_rows())
    assert Counter((r["doc_id"], r["lang_pred"]) for r in made) == want and all(0 <= r["score"] <= 1 for r in made)
    assert {r["lang_pred"] for r in language.identify(odd, F.lit(False)).collect()} == {"und"}
    assert language.identify(none, F.lit(True)).count() == 0


# --- language model ---


def test_language_model_base_scores_and_gain(spark, documents, plain):
    made = {r["doc_id"]: r for r in queries.op8_pitman_yor_scores(spark, "/root/testdata/sf0.001").collect()}
    counts = Counter()
    for d, t in plain:
        if zlib.crc32(str(d).encode()) % 5 != 1:
            counts.update([*brute.words(brute.ascii_lower(t)), None])
    total, kinds = sum(counts.values()), len(counts)
    for d, t in plain:
        tokens = [*brute.words(brute.ascii_lower(t)), None]
        r = made[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(counts[x] > 0 for x in tokens), total)
        assert r["base_score"] == pytest.approx(sum(np.log10((counts[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in tokens), rel=1e-9, abs=1e-6)
        assert r["score"] < 0
    shuffled = spark.createDataFrame([(d, "".join(reversed(t or "")), None, None, None) for d, t in plain[:50]], "doc_id long, text string, lang string, source string, n_chars long")
    backwards = language_model.score_texts(documents.unionByName(shuffled.withColumn("doc_id", F.col("doc_id") + 10_000)), F.col("doc_id") < 10_000)
    later = {r["doc_id"]: r["score"] for r in backwards.collect()}
    assert sum(later[d] for d, _ in plain[:50]) > sum(later[d + 10_000] for d, _ in plain[:50])


def test_language_model_of_odd_rows(odd, none):
    made = language_model.score_texts(odd, F.coalesce(F.col("doc_id") != 9, F.lit(True))).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in made) == Counter((d, len(brute.words(t)) + 1) for d, t, _ in odd_rows())
    assert all(np.isfinite(r["score"]) and r["held_out"] == (r["doc_id"] == 9) for r in made)
    assert language_model.score_texts(none, F.lit(True)).count() == 0
    untrained = language_model.score_texts(odd.where("doc_id = 6"), F.lit(False)).first()
    # One token stands for all that is not known, so its probability is 1, in both scores.
    assert untrained["train_tokens"] == 0 and untrained["score"] == untrained["base_score"] == 0


def test_language_model_beats_its_base_on_held_out_texts(spark):
    made = queries.op8_pitman_yor_scores(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
    assert made[0] > made[1] + 0.3


def test_language_model_through_levels_of_groups(spark, documents, monkeypatch):
    train = common.fold("doc_id", 5) != 1
    few = documents.where("doc_id < 60")
    at_once = {r["doc_id"]: r for r in language_model.score_texts(few, train).collect()}
    monkeypatch.setattr(exchange, "FAN", 4)
    monkeypatch.setattr(exchange, "PER_BUCKET", 1)
    real = language_model.levels_for
    monkeypatch.setattr(language_model, "levels_for", lambda n: max(2, real(n)))
    monkeypatch.setattr(exchange, "levels_for", lambda n: max(2, real(n)))
    for r in language_model.score_texts(few, train).collect():
        same = at_once[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (same["n_tokens"], same["n_known"], same["train_tokens"])
        assert r["base_score"] == pytest.approx(same["base_score"]) and r["score"] == pytest.approx(same["score"], rel=0.05, abs=1.0)


def test_probabilities_of_all_tokens_add_up():
    """Three words are known, and one more token stands for the rest."""
    fit = language_model.Fit((0.4, 0.6), (0.7, 1.3), 10, 5, 3)
    words = [np.array(x) for x in ([0, 6, 5, 4], [0, 4, 3, 3], [0, 2, 2, 1], [0, 3, 3, 1])]
    for context in range(4):
        counts = np.array([[0, 0, 0, 0], [0, 3, 2, 1], [0, 1, 2, 2], [0, 4, 0, 0]][context])
        tables = [np.array([[0, 0, 0, 0], [0, 1, 1, 1], [0, 1, 1, 1], [0, 1, 0, 0]][context])]
        got = language_model.probabilities(np.full(4, context), np.arange(4), counts, words, tables, [fit])
        assert got.sum() == pytest.approx(1) and (got > 0).all()


def exact_tables(customers, urge, discount):
    """The distribution of the number of tables of a dish, whose urge does not change, by summing over all seatings."""
    ways = {1: 1.0}
    for c in range(1, customers):
        more = defaultdict(float)
        for t, w in ways.items():
            more[t] += w * (c - discount * t)
            more[t + 1] += w
        ways = more
    weight = {t: w * urge ** (t - 1) for t, w in ways.items()}
    return {t: w / sum(weight.values()) for t, w in weight.items()}


@pytest.mark.parametrize(("customers", "urge", "discount"), [(2, 0.5, 0.5), (6, 1.5, 0.3), (12, 0.2, 0.8)])
def test_seating_has_the_exact_distribution(customers, urge, discount):
    """Customers reseated one at a time end up at tables as the sum over all seatings says, wherever they start."""
    n = 20_000
    want = exact_tables(customers, urge, discount)
    for start in ([customers], [1] * customers):
        made = seating.Seating(np.full(n, len(start)), np.tile(start, n), discount, np.random.default_rng(customers))
        every = np.arange(n)
        for _ in range(40 * customers):
            made.leave(every)
            made.join(every, np.full(n, urge))
        assert (made.customers == customers).all() and made.sizes.sum() == n * customers and (np.bincount(made.owner) == made.tables).all()
        got = np.bincount(made.tables, minlength=customers + 1)[1:] / n
        assert got == pytest.approx([want[t] for t in range(1, customers + 1)], abs=0.02)


def test_many_customers_are_seated_like_one_after_another():
    rng = np.random.default_rng(3)
    one, many = [], []
    for _ in range(400):
        tables = [1]
        for c in range(1, 300):
            urge, old = 2.0, c - 0.5 * len(tables)
            if rng.random() * (urge + old) < urge:
                tables.append(1)
            else:
                tables[int(rng.choice(len(tables), p=(np.array(tables) - 0.5) / old))] += 1
        one.append((len(tables), max(tables)))
        sizes = seating.seat_many(np.array([1]), 299, 2.0, 0.5, rng)
        assert sizes.sum() == 300
        many.append((len(sizes), sizes.max()))
    assert np.mean(many, axis=0) == pytest.approx(np.mean(one, axis=0), rel=0.08)


def test_customers_come_and_go():
    rng = np.random.default_rng(4)
    made = seating.Seating(np.zeros(500, np.int64), np.zeros(0, np.int64), 0.6, rng)
    for _ in range(6):
        target = np.minimum(rng.zipf(1.4, 500), 3000) - 1
        made.change(target, np.full(500, 0.8))
        assert (made.customers == target).all() and (np.bincount(made.owner, minlength=500) == made.tables).all()
        assert (np.bincount(made.owner, made.sizes, 500) == target).all() and (made.sizes > 0).all() and ((made.tables > 0) == (target > 0)).all()


def test_fitted_discounts_recover_those_of_a_sample():
    """A corpus drawn from a Pitman-Yor restaurant of known discount and strength."""
    rng = np.random.default_rng(5)
    sizes = []
    for _ in range(300):
        tables = []
        for c in range(200):
            if rng.random() * (3.0 + c) < 3.0 + 0.6 * len(tables):
                tables.append(1)
            else:
                tables[int(rng.choice(len(tables), p=(np.array(tables) - 0.6) / (c - 0.6 * len(tables))))] += 1
        sizes.append(tables)
    whole = np.concatenate(sizes)
    fit = language_model.Fit(words=10)
    for _ in range(60):
        seats = seating.Seating(np.ones(len(whole), np.int64), whole, fit.discount[1], rng)
        logs, draws, every = language_model.context_terms(np.full(300, 200), np.array([len(t) for t in sizes]), fit.discount[1], fit.strength[1])
        fit = language_model.refit(fit, {"customers": 10, "tables": 5, "bends": 1.0, "pair_bends": seats.bends(), "logs": logs, "draws": draws, "all_draws": every})
    assert fit.discount[1] == pytest.approx(0.6, abs=0.05) and fit.strength[1] == pytest.approx(3.0, abs=0.8)


# --- search ---


def test_top_k_of_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(size=6) * (1 + i % 5)]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (400, [0.0] * 6), (500, [1.0, 2.0]), (7, rows[7][1]), (200, rows[200][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    whole = [(i, np.floor(1024 * np.array(v)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for at, (i, q) in enumerate(whole):
        if i % 100 == 0:
            found = sorted((-int(q @ v), j) for other, (j, v) in enumerate(whole) if other != at and len(v) == len(q))[:10]
            want += [(i, rank, j, -s) for rank, (s, j) in enumerate(found, 1)]
    assert sorted(map(tuple, top_k.top_k(df).collect())) == sorted(want)
    for bucket, group in ((8, 2), (16, 64)):
        monkeypatch.setattr(top_k, "BUCKET", bucket)
        monkeypatch.setattr(top_k, "GROUP", group)
        assert sorted(map(tuple, top_k.top_k(df.repartition(3)).collect())) == sorted(want)
    assert top_k.top_k(df.where("vec_id = -1")).count() == 0


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_pruning_never_loses_a_candidate(spread):
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(2000, 64))
    vectors = np.floor(1024 * vectors / np.linalg.norm(vectors, axis=1)[:, None] * (1 - spread * rng.random((2000, 1))))
    lengths = np.sqrt((vectors**2).sum(axis=1))
    order = np.argsort(-lengths)
    vectors, lengths = vectors[order], lengths[order]
    kept = []
    for q in vectors[::37]:
        scores = vectors @ q
        for share in (0.2, 0.9, 0.99, 0.995, 1.0):
            bound = float(np.quantile(scores, share))
            place = top_k.candidates(q, float(np.sqrt(q @ q)), bound, vectors, lengths)
            assert set(np.flatnonzero(scores >= bound)) <= set(place.tolist())
            if share >= 0.995:
                kept.append(len(place) / len(vectors))
    # At equal lengths only coordinates prune, and they do.
    assert np.mean(kept) < 0.35


def test_share_of_vectors_that_is_verified():
    """A query's largest coordinates leave few vectors of the tables to verify."""
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    use, rows = top_k.scaled(table.column("embedding"), 1024.0)
    assert use.all()
    matrix, ids = np.array(rows), table.column("vec_id").to_numpy()
    blob = lambda at: exchange.encode_table(pa.table({"rid": ids[at], "vec_id": ids[at], "vector": pa.array([matrix[i].tobytes() for i in at], pa.binary())}))
    asking = np.flatnonzero(ids % 100 == 0)
    search = top_k.Search(blob(asking), matrix.shape[1], 10, {})
    for a in range(0, len(ids), top_k.BUCKET):
        search.meet(blob(np.arange(a, min(len(ids), a + top_k.BUCKET))))
    assert search.met == len(asking) * len(ids) and search.verified < 0.6 * search.met


def test_frequent_lines_go_from_the_texts(spark, sf_dir):
    import corpus_pipeline as cp

    own = lambda i: " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(30))
    footer = lambda i: f"  Page {i} of\t{i + 7}\r"
    rows = [(i if i % 9 else None, f"{footer(i)}\n\n{own(i)}\n{footer(i)}\n \t\nend é {own(i)[:4]}\n", "a" if i % 2 else None) for i in range(80)]
    rows += [(200 + i, f"{own(i)}\n{footer(i)}", "b") for i in range(20)] + [(300, f"{footer(1)}\nx", "a"), (301, None, "a"), (302, f"{own(90)}\n\n", "a")]
    want = Counter((d, f"\n{own(i)}\n \t\nend é {own(i)[:4]}\n", 2) for i, (d, _, _) in enumerate(rows[:80]))
    # Twenty documents are not above the limit.
    want += Counter((d, t, 0) for d, t, _ in [*rows[80:100], rows[102]])
    made = Counter(tuple(r) for r in quality_rules.clean(frame(spark, rows)).select("doc_id", "text", "removed_lines").collect())
    assert made == want
    staged = cp.quality(spark, frame(spark, rows), sf_dir)
    assert Counter((r["doc_id"], r["text"], r["n_chars"]) for r in staged.collect()) == Counter({(d, t, len(t) if cut else None): n for (d, t, cut), n in want.items()})


# --- licences ---


def test_license_inheritance(spark):
    apache, mit = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License. SPDX-License-Identifier: MIT."
    rows = [
        (1, "a/LICENSE", apache), (2, "a/x.py", "code\nmore"), (3, "a/b/c/y.py", "code"), (4, "a/b/COPYING.txt", mit), (5, "a/b/z.py", f"head\n{apache}\nbody"), (6, "q/y.py", None),
        (7, None, "code"), (8, "LICENSE", "All rights reserved."), (9, "top.py", ""), (9, "top.py", ""),
    ]
    got = Counter((r["doc_id"], r["license"], r["license_from"], r["license_dir"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect())
    assert got == Counter([(1, "Apache-2.0", "own", None), (2, "Apache-2.0", "directory", "a"), (3, "MIT", "directory", "a/b"), (4, "MIT", "own", None), (5, "Apache-2.0", "own", None), (6, "Proprietary", "directory", ""), (7, None, None, None), (8, "Proprietary", "own", None), (9, "Proprietary", "directory", ""), (9, "Proprietary", "directory", "")])
    assert licenses.scan(spark.createDataFrame([], "doc_id long, path string, text string")).count() == 0


def test_every_license_line_of_the_documents_is_found(spark, sf_dir, documents):
    forms = {
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT",
        "All rights reserved.": "Proprietary", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    }
    want = {r["doc_id"]: {forms[x] for x in (r["text"] or "").split("\n") if x in forms} for r in documents.collect()}
    for r in queries.op6_license_scan(spark, sf_dir).collect():
        assert (r["own_license"] in want[r["doc_id"]]) if want[r["doc_id"]] else r["own_license"] is None
    texts = documents.select("text").limit(0).unionByName(spark.createDataFrame([(x,) for x in forms for _ in range(60)], "text string"))
    made = licenses.scan(texts.select(F.lit(1).alias("doc_id"), F.lit(None).cast("string").alias("path"), "text"))
    assert Counter(r["own_license"] for r in made.collect()) == Counter({x: 60 for x in forms.values()})


def wrapped(text, width=60, mark="# "):
    lines, line = [], mark
    for w in text.split():
        if len(line) + len(w) > width:
            lines.append(line)
            line = mark
        line += w + " "
    return "\n".join([*lines, line])


def test_whole_notices_over_many_lines(spark):
    t = licenses.TEMPLATES
    holder = "Copyright (c) 2020, Some Holder\nAll rights reserved.\n\n"
    gpl = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n Preamble\n\n  The license is a free, copyleft license for software and other kinds of works.\n"
    rows = [
        ("MIT", "MIT License\n\n" + holder.replace("All rights reserved.\n", "") + wrapped(t["MIT"], 78, "")), ("MIT", "/*\n" + wrapped(t["MIT"], 70, " * ") + "\n */\nint main() {}\n"),
        ("BSD-3-Clause", holder + wrapped(t["BSD-3-Clause"], 72, "")), ("BSD-2-Clause", holder + wrapped(t["BSD-2-Clause"], 72, "")), ("BSD-3-Clause", wrapped(holder.strip() + " " + t["BSD-3-Clause"], 66, "// ") + "\n\ncode here"),
        ("Apache-2.0", wrapped("Copyright 2019 Some Holder " + t["Apache-2.0"], 75, "# ") + "\nimport os\n"), ("GPL-3.0", wrapped(t["GPL-3.0"], 70, "   ")), ("GPL-2.0", wrapped(t["GPL-2.0"], 70, " * ")),
        ("GPL-3.0", gpl), ("LGPL-2.1", wrapped(t["LGPL-2.1"], 50, "-- ")), ("AGPL-3.0", wrapped(t["AGPL-3.0"], 90, "% ")), ("ISC", holder + wrapped(t["ISC"], 60, "")), ("MPL-2.0", wrapped(t["MPL-2.0"], 64, "; ")),
        ("Proprietary", holder + "Do not copy."), (None, "This program counts words.\nIt is fast.\n"), ("MIT", "word " * 50_000 + "\n\n" + wrapped(t["MIT"], 70, " * ") + "\n\n" + "word " * 50_000),
    ]
    files = spark.createDataFrame([(i, f"d{i}/x.c", x, "clash", 1.0) for i, (_, x) in enumerate(rows)], "doc_id long, path string, text string, license string, own_score double")
    got = {r["doc_id"]: r["own_license"] for r in licenses.scan(files).collect()}
    assert got == {i: name for i, (name, _) in enumerate(rows)}


def test_licence_ties_go_to_the_smaller_name(spark):
    files = spark.createDataFrame([(1, "x", "you may copy this licence text freely")], "doc_id long, path string, text string")
    same = {"B": "you may copy this licence text", "A": "you may copy this licence text"}
    assert licenses.scan(files, templates=same).first()["own_license"] == "A"


def test_licences_equal_a_plain_version(spark, sf_dir, documents):
    """TF-IDF and cosines by loops over the documents' table."""
    import re

    split = lambda x: [w for w in re.split("[^a-z0-9]+", x.lower()) if w]
    speaks = lambda x: re.search(licenses.TRIGGERS, x.lower())
    texts, uses = {}, Counter()
    for r in documents.collect():
        text = r["text"] or ""
        paragraphs = [" ".join(split(p)) for p in re.split(r"\n(?:[^\w\n]*\n)+", text) if speaks(p)]
        held = {" ".join(split(x)) for x in text.split("\n") if speaks(x)} | set(paragraphs) | ({" ".join(paragraphs)} if len(paragraphs) > 1 else set())
        texts[r["doc_id"]] = held
        uses.update(held)
    n, df = sum(uses.values()), Counter()
    for x, often in uses.items():
        for w in set(x.split()):
            df[w] += often
    idf = lambda w: math.log(min((n + 1) / (df[w] + 1), licenses.RAREST)) + 1

    def unit(x):
        weights = {w: tf * idf(w) for w, tf in Counter(x).items()}
        norm = math.sqrt(sum(v * v for v in weights.values()))
        return {w: v / norm for w, v in weights.items()}

    known = {k: (unit(split(v)), licenses.name_words(k, v)) for k, v in licenses.TEMPLATES.items()}
    want = {}
    for d, held in texts.items():
        found = []
        for x in held:
            mine = unit(x.split())
            for k, (theirs, needed) in known.items():
                score = round(sum(v * theirs.get(w, 0) for w, v in mine.items()), 6)
                if needed <= set(mine) and score >= licenses.LEAST_COSINE:
                    found.append((k.split(" ")[0] == licenses.WEAKEST, -score, k.split(" ")[0]))
        want[d] = min(found)[2] if found else None
    assert {r["doc_id"]: r["own_license"] for r in queries.op6_license_scan(spark, sf_dir).collect()} == want and any(want.values())


@pytest.mark.parametrize("mass", [1, 5000])
def test_license_forms_at_any_corpus_size(spark, mass):
    plain = ["All rights reserved.", "Licensed under the Apache License, Version 2.0."]
    rows = [(k, v) for k, v in licenses.TEMPLATES.items()] + [(" none", "SPDX-License-Identifier: Zlib"), ("MIT both", "Released under the MIT License. SPDX-License-Identifier: MIT."), ("MIT other", "Licensed under the MIT License.")]
    many = spark.range(mass).select(F.lit("mass").alias("path"), F.explode(F.array(*map(F.lit, plain))).alias("text"))
    files = many.unionByName(spark.createDataFrame(rows, "path string, text string")).withColumn("doc_id", F.lit(1))
    made = licenses.scan(files).where("path <> 'mass'").collect()
    assert {r["path"]: r["own_license"] for r in made} == {k: k.split(" ")[0] or None for k, _ in rows}


# --- pipeline ---


def test_pipeline_equals_plain_stages(spark, sf_dir, documents):
    import corpus_pipeline as cp

    docs = documents
    rows = docs.collect()
    kept = {r["doc_id"] for r in quality_rules.quality_rules(docs).where("kept").collect()}
    stage = cp.quality(spark, docs, sf_dir)
    assert stage.columns == cp.COLUMNS and {r["doc_id"] for r in stage.collect()} == kept
    docs = common.materialize(stage, "t1")
    groups = brute.near([(r["doc_id"], r["text"]) for r in rows if r["doc_id"] in kept])
    docs = common.materialize(cp.near_dedup(spark, docs, sf_dir), "t2")
    left = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    assert [d for d, _ in left] == sorted(d for d, (_, c) in groups.items() if c == d)
    docs = common.materialize(cp.substring_dedup(spark, docs, sf_dir), "t3")
    assert {r["doc_id"]: len(brute.words(r["text"])) for r in docs.collect()} == {d: n - gone for d, n, gone, _ in brute.repeats(left)}
    mixed = common.materialize(cp.mix(spark, docs, sf_dir), "t4")
    want = Counter()
    for r in mixing.mix_sources(docs).collect():
        want[r["doc_id"]] += r["taken"]
    have = Counter()
    for r in mixed.collect():
        have[r["doc_id"]] += len(brute.words(r["text"]))
    assert +have == +want and mixed.columns == cp.COLUMNS
    check_pack([(r["doc_id"], r["text"]) for r in mixed.collect()], cp.packing(spark, mixed, sf_dir).collect())
    assert cp.run(spark, sf_dir).agg(F.sum("length")).first()[0] == cp.packing(spark, mixed, sf_dir).agg(F.sum("length")).first()[0]


def test_pipeline_takes_odd_rows_and_nothing(spark, sf_dir, none):
    import corpus_pipeline as cp

    text = lambda i: " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + i)}" for k in range(120))
    rows = [(1, text(1), "a"), (2, text(1), "a"), (2, text(1), "a"), (3, None, None), (4, "", "a"), (5, text(2), "a"), (5, text(3), "b"), (6, "one two", "b"), (None, text(4), None), (None, text(4), "a"), (7, text(5) + " " + " ".join(f"q{i}" for i in range(400)), "b"), (8, "tail " * 3 + text(5) + " x" + " ".join(f"r{i}" for i in range(400)), "b"), (9, " ".join(f"y{i}" for i in range(60_000)), "c")]
    held = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    by = dict(cp.STAGES)
    docs = common.materialize(by["quality rules"](spark, frame(spark, rows), sf_dir), "odd")
    assert docs.columns == cp.COLUMNS and held(docs) == Counter((d, t) for d, t, _ in rows if t and len(t) > 20)
    docs = common.materialize(by["near-duplicate removal"](spark, docs, sf_dir), "odd")
    want = Counter((d, t) for d, t, _ in rows if t and len(t) > 20 and d != 2)
    assert docs.columns == cp.COLUMNS and held(docs) == want
    docs = common.materialize(by["substring removal"](spark, docs, sf_dir), "odd")
    cut = "tail tail tail x" + " ".join(f"r{i}" for i in range(400))
    assert docs.columns == cp.COLUMNS and held(docs) == want - Counter([(8, rows[11][1])]) + Counter([(8, cut)])
    sizes = Counter(r["doc_id"] for r in docs.collect())
    docs = common.materialize(by["source mixing"](spark, docs, sf_dir), "odd")
    assert docs.columns == cp.COLUMNS and all(1 <= len(brute.words(r["text"])) == len(brute.words(r["text"])) for r in docs.collect()) and set(held(docs)) and {d for d, _ in held(docs)} <= set(sizes)
    check_pack([(r["doc_id"], r["text"]) for r in docs.collect()], by["packing"](spark, docs, sf_dir).collect())
    docs = none
    for _, stage in cp.STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), "none")
        assert docs.count() == 0
    assert "ids" in docs.columns


def test_scratch_tables_go(spark, tmp_path):
    mark = common.tables_written()
    a, b = (common.materialize(spark.range(n), "scratch") for n in (3, 4))
    common.discard(spark, mark, (b,))
    assert b.count() == 4 and common.tables_written() == mark + 1
    with pytest.raises(Exception):
        a.count()


def test_workers_need_no_path(tmp_path):
    code = (
        "import sys; sys.path.insert(0, sys.argv[1])\nfrom pyspark.sql import SparkSession\ns = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', sys.argv[2]).getOrCreate()\n"
        "from mosaiq.llm.substrings import remove_repeats\nassert remove_repeats(s.createDataFrame([(1, 'a b')], 'doc_id long, text string')).first()['kept_text'] == 'a b'\ns.stop()\n"
    )
    subprocess.run([sys.executable, "-c", code, str(Path(__file__).resolve().parents[2]), str(tmp_path / "shared")], cwd=tmp_path, check=True)
