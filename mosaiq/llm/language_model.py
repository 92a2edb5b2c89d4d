"""A hierarchical Pitman-Yor language model over tokens, gathered from the whole corpus.

A text is its lower-cased words and one end. Every token is a context: a restaurant whose dishes
are the tokens seen after it (an end is the context of a text's first token). All contexts share
one parent, the restaurant of single tokens, whose base is uniform over the tokens learned and one
more that stands for all others. Customers of the parent are the tables of the contexts, so the
levels hold one common state. Seating is sampled by Gibbs (see seating), discounts and strengths
are fitted between the rounds, and predictive probabilities are averaged over the last SAMPLES.

1. Words: bundles ask the slots of the hash space; a slot adds up counts and gives each word a number.
2. Pairs of tokens: bundles learn from short hashes which pairs others may have too. A pair that one
   bundle alone has, once, is one customer at one table and needs no seating: the bundle tells the slots
   of words how many such tables there are. It asks about all other pairs by their numbers. A slot holds
   pairs whatever their context, so a context of any size is split over all slots.
3. Rounds: a slot of pairs reseats customers given its words' place in the parent and the tables of
   each context, then tells the slots of words what it has. They seat the parent's customers that
   are new or gone, reseat others, and answer. What other slots do in a round is seen after it.
4. Bundles get, for their distinct words and pairs, the counts and tables of each sample, and score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange
from .common import Words, discard, materialize, mix, prepare, release_memory, tables_written
from .exchange import ANSWER, ASKED, BUNDLE, answer, ask, decode_table, distinct, encode_table, entries, find, gathered, group_starts, levels_for, pack_columns, pack_keys, replies, settle, unpack_columns, unpack_keys, with_answers, with_several_answers
from .seating import Seating, digamma

ROUNDS, SAMPLES = 4, 2
#: Customers of each dish that a round reseats.
STEPS = 4
#: Text bytes of a bundle.
BUNDLE_BYTES = 4 << 20
#: The end of a text, as a word that no text holds.
END = xxhash.xxh3_64_intdigest(b" ")
MOST_WORDS = 1 << 32


@dataclass(frozen=True)
class Fit:
    """Discount and strength of the parent and of the contexts, and the parent's totals."""

    discount: tuple[float, float] = (0.5, 0.7)
    strength: tuple[float, float] = (1.0, 1.0)
    customers: int = 0
    tables: int = 0
    words: int = 0

    def single(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Probability of tokens in the parent."""
        fresh = (self.strength[0] + self.discount[0] * self.tables) / (self.words + 1)
        return (customers - self.discount[0] * tables + fresh) / (self.strength[0] + self.customers)


def refit(fit: Fit, totals: dict[str, float]) -> Fit:
    """Discounts and strengths from the expected auxiliary variables of their sampler, with priors Beta(1, 1) and Gamma(1, 1).

    A restaurant of c customers and t tables has -log x with x ~ Beta(strength + 1, c - 1), and y ~
    Bernoulli(strength / (strength + discount * i)) for i = 1 .. t - 1; the customers of a table give the z.
    """
    customers, tables = int(totals["customers"]), int(totals["tables"])
    logs, draws, all_draws = context_terms(np.array([customers]), np.array([tables]), fit.discount[0], fit.strength[0])
    new = []
    for level, (a, y, n, bends) in enumerate([(logs, draws, all_draws, totals["bends"]), (totals["logs"], totals["draws"], totals["all_draws"], totals["pair_bends"])]):
        strength = (1 + y) / (1 + a)
        discount = (1 + n - y) / (2 + n - y + bends)
        new.append((min(0.95, max(0.01, discount)), min(1e6, max(1e-3, strength))))
    return replace(fit, discount=(new[0][0], new[1][0]), strength=(new[0][1], new[1][1]), customers=customers, tables=tables)


def context_terms(customers: np.ndarray, tables: np.ndarray, discount: float, strength: float) -> tuple[float, float, int]:
    """Sums over restaurants of the expected -log x, of the expected y, and of the number of y."""
    big = customers > 1
    logs = (digamma(strength + customers[big]) - digamma(strength + 1)).sum()
    t = tables[tables > 1]
    y = strength / discount * (digamma(strength / discount + t) - digamma(strength / discount + 1))
    return float(logs), float(y.sum()), int((t - 1).sum())


# --- words ---


def _added(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ascending distinct keys and the sums of their columns."""
    values, place = np.unique(keys, return_inverse=True)
    return values, [np.bincount(place, c, len(values)).astype(np.int64) for c in columns]


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bundles: documents as codes, each text's words and then END, which is code 0; in the first row, the hash of each code."""
    bid = TaskContext.get().partitionId() << 24
    for rows in gathered(batches, "text", BUNDLE_BYTES):
        words = Words(rows.column(1), lower=True)
        # Codes by falling frequency, which keeps them short.
        order = np.argsort(-np.bincount(words.codes, minlength=len(words.dictionary)), kind="stable")
        code = np.empty(len(order), np.uint32)
        code[order] = np.arange(1, len(order) + 1)
        limits = words.first + np.arange(len(words.first))
        codes = np.zeros(limits[-1], np.uint32)
        inside = np.ones(limits[-1], dtype=bool)
        inside[limits[1:] - 1] = False
        codes[inside] = code[words.codes]
        hashes = np.append(np.array([END], np.uint64), words.distinct_hashes()[order])
        train = rows.column(2).to_numpy(zero_copy_only=False).astype(bool)
        columns = [rows.column(0).cast(pa.int64()), pa.array(~train), pa.array(np.diff(limits)), _blob(pack_columns([codes]), len(train)), _in_first_row(hashes, len(train))]
        yield pa.RecordBatch.from_pydict({"bid": pa.array([bid], pa.int64()), "payload": pa.array([encode_table(pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "codes", "hashes"]))], pa.binary())})
        bid += 1
    release_memory()


def _blob(value: bytes, rows: int) -> pa.Array:
    return pa.array([value, *[None] * (rows - 1)], pa.binary())


def _in_first_row(values: np.ndarray, rows: int) -> pa.Array:
    limits = np.full(rows + 1, len(values))
    limits[0] = 0
    return pa.LargeListArray.from_arrays(pa.array(limits), pa.array(values))


def _of_first_row(rows: pa.RecordBatch, name: str) -> np.ndarray:
    return rows.column(name)[0].values.to_numpy(zero_copy_only=False)


def codes_of(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All codes of a bundle, the limits of its texts in them, and whether each is learned from."""
    limits = np.concatenate([[0], np.cumsum(rows.column("n_tokens").to_numpy())])
    return unpack_columns(rows.column("codes")[0].as_py(), "u4"), limits, np.repeat(~rows.column("held_out").to_numpy(zero_copy_only=False), np.diff(limits))


def _ask_words(fan: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bid, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = decode_table(payload.as_py())
                codes, _, learned = codes_of(rows)
                hashes = _of_first_row(rows, "hashes")
                counts = np.bincount(codes[learned], minlength=len(hashes))
                order = np.argsort(hashes)
                yield ask(bid, hashes[order], [counts[order]], fan)
        release_memory()

    return run


def _number_words(slots: int):
    """Per slot: answers (count, number), and a row of state; the word of rank r by count in slot s has number r * slots + s + 1.

    State holds the words learned twice or more. The others, counted as once, are one customer at one table each.
    """

    def run(table: pa.Table) -> pa.Table:
        slot = table.column("slot")[0].as_py()
        keys, (counts,), lengths = entries(table, ["i8"])
        values, (total,) = _added(keys, [counts])
        some = np.flatnonzero(total)
        some = some[np.argsort(-total[some], kind="stable")]
        numbers = np.zeros(len(values), np.int64)
        numbers[some] = np.arange(len(some)) * slots + slot + 1
        if len(some) and numbers.max() >= MOST_WORDS:
            raise ValueError("more distinct words than pairs can be numbered by")
        at = np.searchsorted(values, keys)
        answers = replies(table.column("bid").to_pylist(), lengths, keys, numbers[at] > 0, [total[at], numbers[at].astype(np.uint32)])
        twice = total[some][total[some] > 1]
        none, empty = np.zeros(len(twice), np.int64).tobytes(), np.zeros(0, np.int64).tobytes()
        state = {"slot": [slot], "tokens": [int(total.sum())], "words": [len(some)], "once": [len(some) - len(twice)], "counts": [twice.tobytes()], "fixed": [none + none], "tables": [none], "sizes": [empty], "kept": [empty]}
        return _with_kind(answers, pa.table(state, schema=WORD_STATE), WORDS)

    return run


def _fix(slots: int):
    """Per slot of words: the tables of pairs that no slot of pairs holds, for good, as dishes and in contexts; no answers."""

    def run(asked: pa.Table, state: pa.Table) -> pa.Table:
        keys, columns, _ = entries(asked, ["i8", "i8"]) if asked.num_rows else (np.zeros(0, np.uint64), [np.zeros(0, np.int64)] * 2, None)
        rank = (keys.astype(np.int64) - 1) // slots
        fixed = np.concatenate([np.bincount(rank, c, len(_i8(state, "counts"))).astype(np.int64) for c in columns])
        new = {c: state.column(c) for c in state.column_names} | {"fixed": [fixed.tobytes()]}
        return _with_kind(replies([], np.zeros(0, np.int64), keys[:0], keys[:0] > 0, []), pa.table(new, schema=WORD_STATE), WORDS)

    return run


WORD_STATE = pa.schema([("slot", pa.int64()), ("tokens", pa.int64()), ("words", pa.int64()), ("once", pa.int64()), ("counts", pa.binary()), ("fixed", pa.binary()), ("tables", pa.binary()), ("sizes", pa.binary()), ("kept", pa.binary())])
PAIR_STATE = pa.schema([("slot", pa.int64()), ("pairs", pa.binary()), ("counts", pa.binary()), ("tables", pa.binary()), ("sizes", pa.binary()), ("kept", pa.binary())])
SUMS = ("customers", "tables_sum", "bends", "logs", "draws", "all_draws")
_KIND = [("kind", pa.int32()), ("bid", pa.int64()), ("keys", pa.binary()), ("extra", pa.binary())]
WORDS = pa.schema([*_KIND, *WORD_STATE, *((s, pa.float64()) for s in SUMS)])
PAIRS = pa.schema([*_KIND, *PAIR_STATE, ("bends", pa.float64())])


def _with_kind(messages: pa.Table, state: pa.Table, schema: pa.Schema) -> pa.Table:
    """One table of messages (kind 0) and state (kind 1)."""
    parts = [t.append_column("kind", pa.array(np.full(t.num_rows, kind, np.int32))) for kind, t in enumerate([messages, state])]
    return pa.concat_tables([pa.table([p.column(f.name).cast(f.type) if f.name in p.column_names else pa.nulls(p.num_rows, f.type) for f in schema], schema=schema) for p in parts])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.float64(): "double"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _i8(table: pa.Table, name: str) -> np.ndarray:
    return np.frombuffer(table.column(name)[0].as_py(), np.int64)


def by_slot(slots: int):
    """Numbers of words to values by which exchange finds the slot that numbered them."""

    def spread(numbers: np.ndarray) -> np.ndarray:
        slot = (numbers - np.uint64(1)) % np.uint64(slots)
        return ((slot << np.uint64(32)) // np.uint64(slots) + np.uint64(1)) << np.uint64(32)

    return spread


def _seat_words(slots: int, fit: Fit, seed: int, keep: bool):
    """Per slot of words: customers as the pairs now have tables; answers (customers, tables, tables of the word as a context), new state, sums."""

    def run(asked: pa.Table, state: pa.Table) -> pa.Table:
        slot = state.column("slot")[0].as_py()
        keys, columns, lengths = entries(asked, ["i8", "i8"]) if asked.num_rows else (np.zeros(0, np.uint64), [np.zeros(0, np.int64)] * 2, np.zeros(0, np.int64))
        rank = (keys.astype(np.int64) - 1) // slots
        counts, tables = _i8(state, "counts"), _i8(state, "tables")
        fixed = _i8(state, "fixed").reshape(2, len(counts))
        rank = np.minimum(rank, len(counts))  # words learned once come last, and are all alike
        target, context = (np.bincount(rank, c, len(counts) + 1).astype(np.int64)[:-1] + f for c, f in zip(columns, fixed, strict=True))
        rng = np.random.default_rng([seed, slot])
        seating = Seating(tables, _i8(state, "sizes"), fit.discount[0], rng)
        urge = np.full(len(counts), (fit.strength[0] + fit.discount[0] * max(fit.tables, fit.words)) / (fit.words + 1))
        seating.change(target, urge)
        live = np.flatnonzero(seating.customers > 1)
        for _ in range(STEPS):
            seating.leave(live)
            seating.join(live, urge[live])
        kept = np.concatenate([_i8(state, "kept"), seating.customers, seating.tables, context]) if keep else _i8(state, "kept")
        made = [np.append(c, 1)[rank] for c in (seating.customers, seating.tables, context)]
        answers = replies(asked.column("bid").to_pylist(), lengths, keys, np.ones(len(keys), dtype=bool), made)
        logs, draws, all_draws = context_terms(counts, context, fit.discount[1], fit.strength[1])
        once = state.column("once")[0].as_py()
        sums = zip(SUMS, (seating.customers.sum() + once, seating.tables.sum() + once, seating.bends(), logs, draws, all_draws), strict=True)
        new = {c: state.column(c) for c in WORD_STATE.names} | {"tables": [seating.tables.tobytes()], "sizes": [seating.sizes.tobytes()], "kept": [kept.tobytes()]}
        return _with_kind(answers, pa.table({**new, **{k: pa.array([float(v)]) for k, v in sums}}), WORDS)

    return run


# --- pairs ---


def pairs_of(codes: np.ndarray) -> np.ndarray:
    """(token before, token) of every token as one number; what comes before a text is the end of the one before, or an end like it."""
    before = np.concatenate([codes[-1:], codes[:-1]]).astype(np.uint64)
    return before << np.uint64(32) | codes


def prints(pairs: np.ndarray, bits: int) -> np.ndarray:
    """Hashes of so many bits, at the upper end of 64."""
    return mix(pairs) & np.uint64((1 << 64) - (1 << (64 - bits)))


def learned_pairs(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the distinct pairs of a bundle: the code before, the code, the pair of numbers, how often it is learned here; and each token's pair.

    A pair of numbers is 0 where a token is not known.
    """
    codes, _, learned = codes_of(rows)
    whole = pairs_of(codes)
    order = np.argsort(whole)
    whole = whole[order]
    starts = group_starts(whole)
    pairs = whole[starts]
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(starts) - 1
    counts = np.bincount(place[learned], minlength=len(pairs))
    numbers = _of_first_row(rows, "numbers").astype(np.uint64)
    before, code = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(MOST_WORDS - 1)).astype(np.int64)
    v, w = numbers[before], numbers[code]
    return before, code, np.where((v > 0) & (w > 0), v << np.uint64(32) | w, np.uint64(0)), counts, place


QUESTIONS = pa.schema([("kind", pa.int32()), ("slot", pa.int64()), ("bid", pa.int64()), ("keys", pa.binary()), ("extra", pa.binary())])


def _number_tokens(tokens: int, words: int):
    """Per bundle: its documents with their base scores, and of each code the number and whether it is learned twice or more."""
    bottom = math.log10(tokens + 0.5 * (words + 1))
    schema = pa.schema([("bid", pa.int64()), ("payload", pa.binary())])

    def run(bid: int, rows: pa.RecordBatch | None, known: np.ndarray, columns: list[np.ndarray]) -> pa.Table:
        if rows is None:
            return schema.empty_table()
        hit, at = find(_of_first_row(rows, "hashes"), known)
        counts, numbers = (np.where(hit, c[at], 0) if len(known) else np.zeros(len(hit), np.int64) for c in columns)
        codes, limits, _ = codes_of(rows)
        base = _sums(np.log10(counts + 0.5)[codes], limits) - np.diff(limits) * bottom
        made = [*rows.columns[:4], pa.array(_sums((counts > 0)[codes], limits).astype(np.int64)), pa.array(base), _in_first_row(numbers.astype(np.uint32), rows.num_rows), _in_first_row(counts > 1, rows.num_rows)]
        documents = encode_table(pa.RecordBatch.from_arrays(made, [*rows.schema.names[:4], "n_known", "base_score", "numbers", "often"]))
        release_memory()
        return pa.table([pa.array([bid], pa.int64()), pa.array([documents], pa.binary())], schema=schema)

    return run


def _sums(values: np.ndarray, limits: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[limits[1:]] - total[limits[:-1]]


def _ask_prints(fan: int, bits: int):
    """Per bundle of documents as numbers: the prints of its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bid, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                pairs = learned_pairs(decode_table(payload.as_py()))[2]
                keys = distinct(prints(pairs[pairs > 0], bits))
                yield ask(bid, keys, [np.zeros(len(keys), np.uint8)], fan)
        release_memory()

    return run


def _several(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Prints, and 1 for those that more than one asker has."""
    values, often = np.unique(keys, return_counts=True)
    return values, [(often > 1).astype(np.uint8) if not columns else ((often > 1) | (np.bincount(np.searchsorted(values, keys), columns[0], len(values)) > 0)).astype(np.uint8)]


def _ask_pairs(fan: int, slots: int, bits: int):
    """Per bundle, which knows the prints that others have too: questions for pairs and for words, with the tables of all other pairs."""

    def run(bid: int, rows: pa.RecordBatch | None, shared: np.ndarray, _: list[np.ndarray]) -> pa.Table:
        if rows is None:
            return QUESTIONS.empty_table()
        before, code, pairs, counts, _ = learned_pairs(rows)
        open_pairs = (pairs > 0) & ((counts > 1) | find(prints(pairs, bits), shared)[0])
        alone = (pairs > 0) & ~open_pairs & (counts > 0)
        numbers, often = _of_first_row(rows, "numbers").astype(np.uint64), _of_first_row(rows, "often")
        order = np.argsort(numbers[often])
        numbers = numbers[often][order]
        tables = [np.bincount(side[alone], minlength=len(often))[often][order] for side in (code, before)]
        order = np.argsort(pairs[open_pairs])
        asked = [ask(bid, pairs[open_pairs][order], [counts[open_pairs][order]], fan, mix), ask(bid, numbers, tables, fan, by_slot(slots))]
        return pa.concat_tables([pa.table([pa.array(np.full(some.num_rows, kind, np.int32)), *some.columns], schema=QUESTIONS) for kind, some in enumerate(asked, 1)])

    return run


def _words_asked(slot: int, pairs: np.ndarray, tables: np.ndarray, fan: int, slots: int) -> pa.Table:
    """Questions of a slot of pairs: for each word the tables of its dishes, and those in its own restaurant."""
    numbers, place = np.unique(np.concatenate([pairs & np.uint64(MOST_WORDS - 1), pairs >> np.uint64(32)]), return_inverse=True)
    dish = np.bincount(place[: len(pairs)], tables, len(numbers)).astype(np.int64)
    context = np.bincount(place[len(pairs) :], tables, len(numbers)).astype(np.int64)
    return pa.Table.from_batches([ask(slot, numbers, [dish, context], fan, by_slot(slots))])


def _first_pairs(fan: int, slots: int):
    """Per slot of pairs: those learned, at one table each, and what they ask."""

    def run(table: pa.Table) -> pa.Table:
        slot = table.column("slot")[0].as_py()
        keys, counts, _ = entries(table, ["i8"])
        pairs, (total,) = _added(keys, counts)
        pairs, total = pairs[total > 0], total[total > 0]
        one = np.ones(len(pairs), np.int64)
        state = {"slot": [slot], "pairs": [pack_keys(pairs)], "counts": [total.tobytes()], "tables": [b""], "sizes": [b""], "kept": [b""], "bends": [0.0]}
        return _pair_rows(slot, pairs, one, fan, slots, state)

    return run


def _pair_rows(slot: int, pairs: np.ndarray, tables: np.ndarray, fan: int, slots: int, state: dict) -> pa.Table:
    return _with_kind(_words_asked(slot, pairs, tables, fan, slots), pa.table(state), PAIRS)


def _seat_pairs(fan: int, slots: int, fit: Fit, seed: int, keep: bool):
    """Per slot of pairs: customers reseated, what they ask, new state and bends."""

    def run(state: pa.Table, answers: pa.Table) -> pa.Table:
        slot = state.column("slot")[0].as_py()
        pairs, counts = unpack_keys(state.column("pairs")[0].as_py()), _i8(state, "counts")
        numbers, (customers, tables, context), _ = entries(answers, ["i8", "i8", "i8"]) if answers.num_rows else (np.zeros(0, np.uint64), [np.zeros(0, np.int64)] * 3, None)
        order = np.argsort(numbers)
        numbers, customers, tables, context = numbers[order], customers[order], tables[order], context[order].astype(np.float64)
        alone = counts == 1
        live = pairs[~alone]
        above = fit.single(customers, tables)[np.searchsorted(numbers, live & np.uint64(MOST_WORDS - 1))]
        room = np.searchsorted(numbers, live >> np.uint64(32))
        rng = np.random.default_rng([seed, slot])
        urge = lambda: (fit.strength[1] + fit.discount[1] * context[room]) * above
        if state.column("tables")[0].as_py():
            seating = Seating(_i8(state, "tables"), _i8(state, "sizes"), fit.discount[1], rng)
        else:
            seating = Seating(np.zeros(len(live), np.int64), np.zeros(0, np.int64), fit.discount[1], rng)
            seating.change(counts[~alone], urge())
        every = np.arange(len(live))
        for _ in range(STEPS):
            gone = seating.leave(every)
            np.subtract.at(context, room[gone], 1)
            opened = seating.join(every, urge())
            np.add.at(context, room[opened], 1)
        whole = np.ones(len(pairs), np.int64)
        whole[~alone] = seating.tables
        kept = state.column("kept")[0].as_py() + (seating.tables.tobytes() if keep else b"")
        new = {"slot": [slot], "pairs": state.column("pairs"), "counts": state.column("counts"), "tables": [seating.tables.tobytes()], "sizes": [seating.sizes.tobytes()], "kept": [kept], "bends": [seating.bends()]}
        return _pair_rows(slot, pairs, whole, fan, slots, new)

    return run


def _tell_pairs(samples: int):
    """Answers to those who asked for pairs: (count, tables of each sample); none for pairs that were not learned."""

    def run(asked: pa.Table, state: pa.Table) -> pa.Table:
        keys, _, lengths = entries(asked, ["i8"])
        pairs, total = unpack_keys(state.column("pairs")[0].as_py()), _i8(state, "counts")
        live = total > 1
        tables = np.ones((samples, len(pairs)), np.int64)
        tables[:, live] = _i8(state, "kept").reshape(samples, -1)
        hit, at = find(keys, pairs)
        made = [total[at], *(t[at] for t in tables)] if len(pairs) else [np.zeros(len(keys), np.int64)] * (samples + 1)
        return replies(asked.column("bid").to_pylist(), lengths, keys, hit, made)

    return run


def _tell_words(slots: int, samples: int):
    """Answers to those who asked for words: (count, then customers, tables and tables as a context of each sample)."""

    def run(asked: pa.Table, state: pa.Table) -> pa.Table:
        keys, _, lengths = entries(asked, ["i8", "i8"])
        rank = (keys.astype(np.int64) - 1) // slots
        counts = _i8(state, "counts")
        rows = _i8(state, "kept").reshape(3 * samples, len(counts))
        return replies(asked.column("bid").to_pylist(), lengths, keys, np.ones(len(keys), dtype=bool), [counts[rank], *(r[rank] for r in rows)])

    return run


# --- scores ---

SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def probabilities(before: np.ndarray, code: np.ndarray, counts: np.ndarray, words: list[np.ndarray], tables: list[np.ndarray], fits: list[Fit]) -> np.ndarray:
    """The averaged predictive probability of pairs of codes.

    counts: of each pair; tables: of each pair in each sample; words: of each code its count, and its
    (customers, tables, tables as a context) in each sample.
    """
    out = np.zeros(len(code))
    for s, fit in enumerate(fits):
        d, a = fit.discount[1], fit.strength[1]
        share = (a + d * words[3 * s + 3]) / (a + words[0])
        above = fit.single(words[3 * s + 1], words[3 * s + 2])
        out += (counts - d * tables[s]) / (a + words[0])[before] + share[before] * above[code]
    return out / len(fits)


def _score(tokens: int, fits: list[Fit]):
    def run(bid: int, rows: pa.RecordBatch | None, found: list[tuple[np.ndarray, list[np.ndarray]]]) -> pa.Table:
        if rows is None:
            return SCORES.empty_table()
        (known, of_pairs), (numbers, of_words) = found
        limits = np.concatenate([[0], np.cumsum(rows.column("n_tokens").to_numpy())])
        before, code, pairs, here, place = learned_pairs(rows)
        # A pair without an answer is learned from here alone, once, or not at all; so is a word, anywhere.
        hit, at = find(pairs, known)
        own = np.where(pairs > 0, here, 0)
        counts, *tables = (np.where(hit, c[at], own) if len(known) else own for c in of_pairs)
        mine = _of_first_row(rows, "numbers").astype(np.uint64)
        hit, at = find(mine, numbers)
        words = [np.where(hit, c[at], mine > 0) if len(numbers) else (mine > 0).astype(np.int64) for c in of_words]
        logs = np.log10(probabilities(before, code, counts, words, tables, fits))[place]
        out = [rows.column("doc_id"), rows.column("held_out"), rows.column("n_tokens"), rows.column("n_known"), pa.array(np.full(rows.num_rows, tokens)), rows.column("base_score"), pa.array(_sums(logs, limits))]
        return pa.Table.from_arrays(out, schema=SCORES)

    return run


def _totals(rows: DataFrame, names: dict[str, str]) -> dict[str, float]:
    """Sums of a few columns over the rows of state, one of each slot."""
    got = rows.where("kind = 1").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in names.items())).first()
    return got.asDict()


def score_texts(docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Log10 probabilities of all texts under the model and a smoothed unigram, learned from the rows where train holds.

    One row per row of docs: doc_id, held_out (train does not hold), n_tokens (words and one end),
    n_known, train_tokens, base_score, score. Words that were not learned count as one further
    token, in both scores. Null text is an empty text: its end is its only token. Null and
    repeated ids are rows like others; other columns are ignored; an empty table gives an empty
    result; without training rows nothing is known and all scores are 0. One document must fit a
    worker's memory some thirty times over.
    """
    spark = docs.sparkSession
    prepare(spark)
    mark = tables_written()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    bundles = materialize(rows.mapInArrow(_spell, BUNDLE), "lm-bundles")
    count = bundles.count()
    levels = levels_for(count)
    fan = exchange.FAN
    slots = fan**levels
    made: dict[str, DataFrame] = {}

    def number(asked: DataFrame) -> DataFrame:
        made["words"] = materialize(asked.groupBy("slot").applyInArrow(_number_words(slots), _ddl(WORDS)), "lm-words")
        return made["words"].where("kind = 0").select("bid", "keys", "extra")

    numbered = settle(bundles.mapInArrow(_ask_words(fan), ASKED), count, levels, ["i8"], _added, number, ["i8", "u4"])
    discard(spark, tables_written())  # shuffles only: the answers may still need tables of the exchange
    known = _totals(made["words"], {"tokens": "tokens", "words": "words"})
    fit = Fit(words=int(known["words"]))
    bits = min(64, int(known["tokens"]).bit_length() + 8)
    documents = materialize(with_answers(bundles, numbered, ["i8", "u4"], _number_tokens(int(known["tokens"]), fit.words), "bid long, payload binary"), "lm-documents")
    discard(spark, mark, (documents, made["words"]))
    of_kind = lambda df, kind: df.where(F.col("kind") == kind).select("slot", "bid", "keys", "extra")

    def decide(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        values, (shared,) = _several(keys, columns)
        return shared[np.searchsorted(values, keys)] > 0, []

    shared = answer(documents.mapInArrow(_ask_prints(fan, bits), ASKED), count, ["u1"], _several, decide, [])
    questions = materialize(with_answers(documents, shared, [], _ask_pairs(fan, slots, bits), "kind int, slot long, bid long, keys binary, extra binary"), "lm-questions")

    discard(spark, mark, (documents, questions, made["words"]))

    def fix(asked: DataFrame) -> DataFrame:
        made["words"] = materialize(asked.groupBy("slot").cogroup(made["words"].where("kind = 1").groupBy("slot")).applyInArrow(_fix(slots), _ddl(WORDS)), "lm-words")
        return made["words"].where("kind = 0").select("bid", "keys", "extra")

    settle(of_kind(questions, 2), count, levels, ["i8", "i8"], _added, fix, [], by_slot(slots))
    discard(spark, mark, (documents, questions, made["words"]))
    fits: list[Fit] = []

    def sample(asked: DataFrame) -> DataFrame:
        """All rounds; then the answers of the slots of pairs."""
        nonlocal fit
        mark = tables_written()
        pairs = materialize(asked.groupBy("slot").applyInArrow(_first_pairs(fan, slots), _ddl(PAIRS)), "lm-pairs")
        for turn in range(ROUNDS + 1):
            keep = turn > ROUNDS - SAMPLES
            seat = _seat_words(slots, fit, 2 * turn, keep)
            before = made["words"].where("kind = 1")

            def finish(told: DataFrame, seat=seat, before=before) -> DataFrame:
                made["words"] = materialize(told.groupBy("slot").cogroup(before.groupBy("slot")).applyInArrow(seat, _ddl(WORDS)), "lm-words")
                return made["words"].where("kind = 0").select("bid", "keys", "extra")

            told = pairs.where("kind = 0").select("slot", "bid", "keys", "extra")
            answers = settle(told, slots, levels, ["i8", "i8"], _added, finish, ["i8", "i8", "i8"], by_slot(slots))
            now = _totals(made["words"], {"customers": "customers", "tables": "tables_sum", **{k: k for k in SUMS[2:]}}) | _totals(pairs, {"pair_bends": "bends"})
            fit = replace(fit, customers=int(now["customers"]), tables=int(now["tables"]))
            if keep:
                fits.append(fit)
            if turn < ROUNDS:
                fit = refit(fit, now) if turn else fit
                seat_pairs = _seat_pairs(fan, slots, fit, 2 * turn + 1, turn + 1 > ROUNDS - SAMPLES)
                pairs = materialize(pairs.where("kind = 1").groupBy("slot").cogroup(answers.groupBy("bid")).applyInArrow(seat_pairs, _ddl(PAIRS)), "lm-pairs")
            discard(spark, mark, (pairs, made["words"]))
        return asked.groupBy("slot").cogroup(pairs.where("kind = 1").groupBy("slot")).applyInArrow(_tell_pairs(SAMPLES), ANSWER)

    def tell(asked: DataFrame) -> DataFrame:
        return asked.groupBy("slot").cogroup(made["words"].where("kind = 1").groupBy("slot")).applyInArrow(_tell_words(slots, SAMPLES), ANSWER)

    of_pairs, of_words = ["i8"] * (1 + SAMPLES), ["i8"] * (1 + 3 * SAMPLES)
    pair_answers = settle(of_kind(questions, 1), count, levels, ["i8"], _added, sample, of_pairs, mix)
    word_answers = settle(of_kind(questions, 2), count, levels, ["i8", "i8"], _added, tell, of_words, by_slot(slots))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return with_several_answers(documents, [pair_answers, word_answers], [of_pairs, of_words], _score(int(known["tokens"]), fits), schema)
