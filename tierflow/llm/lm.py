"""Scores of texts by online logistic mixing of hashed-context bit predictors.

A text is a row of bytes with an end mark.  Each byte is eight binary choices.
For every order from 0 to 5 a predictor looks the last bytes and the choices
so far up in a hashed table of counts and gives the logarithm of the odds of a
one.  The odds are added with weights chosen by the choice's place in the byte
and by how often the context was seen; a last table, by the choice and the
mixed odds, refines the result.

Learning.  The training texts are reduced to counts of six-byte strings, which
hold all that the predictors see; they are summed over the whole corpus.  The
tables are counts over these strings.  Then the weights learn online, string
after string, in every partition: predict, compare, correct; a string's own
occurrence is taken out of the counts that predict it.  The partitions' weights
are averaged, and the last table is counted with them.  Table sizes are a
parameter, as the memory of such a model always is, and bound what tasks get.

The base score is a unigram model with one added to each count.  Words are
counted per batch, batches meet by word, and the totals go back to the batches,
so a frequent word adds a row per batch at most.

Defined results: a null or empty text has the end mark alone; a null id falls
into the fold of the empty id; repeated rows get equal scores; without any
training text all odds are even and all counts 0; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierflow.llm.columnar import chunks, mixed, table, text_bytes
from tierflow.llm.tables import pieces_for
from tierflow.runtime import cut_lineage

ORDERS = 6
# Slots of each order's table, as powers of two.
TABLE_BITS = (12, 18, 22, 22, 22, 22)
# Strings one task counts into a table of its own.
TASK_STRINGS = 1 << 23
CHUNK = 8 << 20
# Strings scored at once.
BLOCK = 1 << 15
START, END = 0xFE, 0xFF  # no byte of a UTF-8 text
# A slot holds odds in steps of 1 / 64 and how often it was seen, in 32 steps.
STEP, LEVELS = 64, 32
SLOT_BLOCK = 1 << 13
STRETCH_SPAN, STRETCH_STEPS = 8, 33

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


# ---- strings and slots ----


def framed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Six-byte strings that end in each byte and end mark, and their offsets."""
    # Five starts before each text, the end mark after it.
    before = ORDERS - 1
    longest = int(np.diff(offsets).max(initial=0))
    frame = np.empty(before + longest + 9, np.uint8)
    frame[:before] = START
    mask = np.uint64((1 << 8 * ORDERS) - 1)
    bounds = offsets + np.arange(len(offsets))
    out = np.empty(bounds[-1], np.uint64)
    for a, b, at in zip(offsets[:-1].tolist(), offsets[1:].tolist(), bounds.tolist(), strict=False):
        n = b - a
        frame[before : before + n] = data[a:b]
        frame[before + n] = END
        words = np.ndarray(n + 1, "<u8", frame, strides=(1,))
        np.bitwise_and(words, mask, out=out[at : at + n + 1])
    return out, bounds


def slots(strings: np.ndarray, order: int, bits: int) -> list[np.ndarray]:
    """Slot of the eight choices of each string's last byte in one table.

    Choices of one half of a byte stand next to each other.
    """
    last = strings >> np.uint64(8 * (ORDERS - 1))
    context = strings & np.uint64((1 << 8 * (ORDERS - 1)) - 1)
    context = context >> np.uint64(8 * (ORDERS - 1 - order)) if order else context * np.uint64(0)
    high = last >> np.uint64(4)
    mask = np.uint64((1 << bits) - 16)
    out = []
    for half, name in ((high, context * np.uint64(32)), (last & np.uint64(15), context * np.uint64(32) + np.uint64(16) + high)):
        base = mixed(name * np.uint64(8) + np.uint64(order + 1)) & mask
        for k in range(4):
            inside = np.uint64(1 << k) | half >> np.uint64(4 - k)
            out.append((base | inside).astype(np.int64))
    return out


def choice(strings: np.ndarray, k: int) -> np.ndarray:
    """The k-th choice, from the top bit, of each string's last byte."""
    return (strings >> np.uint64(8 * ORDERS - 1 - k) & np.uint64(1)).astype(np.int64)


# ---- counts to odds ----


def level(n: np.ndarray) -> np.ndarray:
    """Counts to 15 as they are, larger ones by their logarithm."""
    large = np.minimum(LEVELS - 1, 12 + np.log2(np.maximum(n, 1)).astype(np.int64))
    return np.where(n < 16, n, large).astype(np.int64)


def slot_values(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    odds = np.log((n1 + 0.4) / (n0 + 0.4))
    steps = np.clip(np.rint(odds * STEP), -1023, 1023).astype(np.int64)
    return (steps * LEVELS + level(np.rint(n0 + n1))).astype(np.int16)


@cache
def without_one() -> np.ndarray:
    """Slot values less one occurrence of a 0 or a 1, for small counts."""
    values = np.arange(-(1 << 15), 1 << 15)
    n = values % LEVELS
    steps = values // LEVELS
    share = 1 / (1 + np.exp(-steps / STEP))
    ones = np.clip(np.rint(share * (n + 0.8) - 0.4), 0, n)
    out = np.empty((2, len(values)), np.int16)
    for bit in (0, 1):
        n1 = np.maximum(ones - bit, 0)
        n0 = np.maximum(n - ones - (1 - bit), 0)
        less = slot_values(n0, n1)
        out[bit] = np.where((n > 0) & (n < 16), less, values)
    return out


class Model:
    """Tables of slot values, weights, and the last table of odds."""

    def __init__(self, tables: list[np.ndarray], weights=None, last=None):
        self.tables = tables
        if weights is None:
            weights = np.full((8, ORDERS, LEVELS), 0.3)
            weights[:, :, 0] = 0
        self.weights = weights
        self.last = last

    def inputs(self, strings: np.ndarray):
        """For each of the eight choices the slot values of every order."""
        per_order = [slots(strings, o, b) for o, b in enumerate(TABLE_BITS)]
        for k in range(8):
            yield k, [self.tables[o][per_order[o][k]] for o in range(ORDERS)]

    def mixed_odds(self, k: int, values: list[np.ndarray]):
        """Weighted odds, the levels and the odds of every order."""
        total = np.zeros(len(values[0]))
        levels, odds = [], []
        for o, v in enumerate(values):
            v = v.astype(np.int64)
            levels.append(v % LEVELS)
            odds.append((v // LEVELS) * (1 / STEP))
            total += self.weights[k, o][levels[-1]] * odds[-1]
        return np.clip(total, -STRETCH_SPAN, STRETCH_SPAN), levels, odds

    def refined(self, node: np.ndarray, odds: np.ndarray) -> np.ndarray:
        """Mean of the mixed odds and those of the last table."""
        if self.last is None:
            return odds
        place = (odds + STRETCH_SPAN) * ((STRETCH_STEPS - 1) / (2 * STRETCH_SPAN))
        low = np.minimum(place.astype(np.int64), STRETCH_STEPS - 2)
        part = place - low
        flat = self.last.ravel()
        at = node * STRETCH_STEPS + low
        return (odds + flat[at] * (1 - part) + flat[at + 1] * part) / 2

    def cost(self, strings: np.ndarray) -> np.ndarray:
        """log10 of the probability of each string's last byte."""
        out = np.zeros(len(strings))
        for a in range(0, len(strings), BLOCK):
            some = strings[a : a + BLOCK]
            last = (some >> np.uint64(8 * (ORDERS - 1))).astype(np.int64)
            for k, values in self.inputs(some):
                odds, _, _ = self.mixed_odds(k, values)
                odds = self.refined(1 << k | last >> (8 - k), odds)
                signed = np.where(choice(some, k) == 1, odds, -odds)
                out[a : a + BLOCK] -= np.logaddexp(0, -signed)
        return out / np.log(10)


# ---- learning ----

_STRINGS = pa.schema([("string", pa.int64()), ("n", pa.int64())])


def string_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``string, n`` over all texts."""

    def count(batches):
        for batch in chunks(batches, "text", CHUNK):
            strings, _ = framed(*text_bytes(batch.column("text")))
            strings.sort()
            starts = np.flatnonzero(np.diff(strings, prepend=~np.uint64(0)))
            n = np.diff(np.append(starts, len(strings)))
            yield table(_STRINGS, string=strings[starts].view(np.int64), n=n)

    return (
        docs.select(docs[text].alias("text"))
        .mapInArrow(count, "string long, n long")
        .groupBy("string")
        .agg(F.sum("n").alias("n"))
    )


_BLOCKS = pa.schema(
    [("order", pa.int32()), ("block", pa.int32()), ("zeros", pa.binary()), ("ones", pa.binary())]
)


def _columns(batch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("string").to_numpy().view(np.uint64), batch.column("n").to_numpy()


def build_tables(strings: DataFrame) -> list[np.ndarray]:
    """Slot values of every order; only their bounded tables reach the driver."""

    def count(batches):
        parts = [_columns(batch) for batch in batches]
        # One order after the other, so that whole numbers need no more memory.
        for order, bits in enumerate(TABLE_BITS):
            sums = np.zeros((2, 1 << bits), np.int64)
            for names, n in parts:
                for k, at in enumerate(slots(names, order, bits)):
                    one = choice(names, k) == 1
                    np.add.at(sums[0], at[~one], n[~one])
                    np.add.at(sums[1], at[one], n[one])
            for block in range(-(-sums.shape[1] // SLOT_BLOCK)):
                part = sums[:, block * SLOT_BLOCK : (block + 1) * SLOT_BLOCK]
                if part.any():
                    # Four bytes a count where they hold it.
                    part = part.astype("<u4") if part.max() < 1 << 32 else part
                    yield table(
                        _BLOCKS,
                        order=[order],
                        block=[block],
                        zeros=pa.array([part[0].tobytes()], pa.binary()),
                        ones=pa.array([part[1].tobytes()], pa.binary()),
                    )

    def add(rows: pa.Table) -> pa.Table:
        size = min(SLOT_BLOCK, 1 << TABLE_BITS[rows.column("order")[0].as_py()])
        total = [
            sum(np.frombuffer(x, f"<u{len(x) // size}").astype(np.int64) for x in rows.column(c).to_pylist())
            for c in ("zeros", "ones")
        ]
        values = slot_values(*total)
        return pa.table(
            {
                "order": pa.array([rows.column("order")[0].as_py()], pa.int32()),
                "block": pa.array([rows.column("block")[0].as_py()], pa.int32()),
                "values": pa.array([values.tobytes()], pa.binary()),
            }
        )

    blocks = (
        strings.mapInArrow(count, "order int, block int, zeros binary, ones binary")
        .groupBy("order", "block")
        .applyInArrow(add, "order int, block int, values binary")
    )
    tables = [np.zeros(1 << b, np.int16) for b in TABLE_BITS]
    for row in blocks.collect():
        values = np.frombuffer(row["values"], np.int16)
        at = row["block"] * SLOT_BLOCK
        tables[row["order"]][at : at + len(values)] = values
    return tables


# Strings between two corrections of the weights, and the size of the first one.
BATCH = 1024
RATE = 0.05


def learn_weights(strings: DataFrame, tables) -> np.ndarray:
    """Weights learned online in every partition, averaged by strings seen.

    Each weight's step shrinks with the corrections it had, so weights of rare
    states move as freely as those of frequent ones.
    """

    def work(batches):
        model, seen = Model(tables.value), 0
        less = without_one()
        moved = np.full_like(model.weights, 1e-6)
        for batch in batches:
            names, n = _columns(batch)
            for a in range(0, len(names), BATCH):
                some, share = names[a : a + BATCH], n[a : a + BATCH].astype(np.float64)
                share /= share.sum()
                seen += len(some)
                for k, values in model.inputs(some):
                    bit = choice(some, k)
                    values = [less[bit, v.astype(np.int64) + (1 << 15)] for v in values]
                    total, levels, odds = model.mixed_odds(k, values)
                    error = (bit - 1 / (1 + np.exp(-total))) * share
                    for o in range(ORDERS):
                        slope = np.bincount(levels[o], error * odds[o], LEVELS)
                        moved[k, o] += slope * slope
                        model.weights[k, o] += RATE * slope / np.sqrt(moved[k, o])
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array([seen]), pa.array([model.weights.tobytes()], pa.binary())],
                ["seen", "weights"],
            )

    rows = strings.mapInArrow(work, "seen long, weights binary").collect()
    if not rows:
        return Model([]).weights
    parts = [np.frombuffer(r["weights"]).reshape(8, ORDERS, LEVELS) for r in rows]
    return np.average(parts, axis=0, weights=[r["seen"] for r in rows])


def learn_last(strings: DataFrame, tables, weights: np.ndarray) -> np.ndarray:
    """Odds of a one by the choice and the mixed odds, from counts."""

    def work(batches):
        model = Model(tables.value, weights)
        less = without_one()
        sums = np.zeros((2, 256 * STRETCH_STEPS))
        for batch in batches:
            names, n = _columns(batch)
            for a in range(0, len(names), BLOCK):
                some, share = names[a : a + BLOCK], n[a : a + BLOCK]
                byte = (some >> np.uint64(8 * (ORDERS - 1))).astype(np.int64)
                for k, values in model.inputs(some):
                    bit = choice(some, k)
                    values = [less[bit, v.astype(np.int64) + (1 << 15)] for v in values]
                    odds, _, _ = model.mixed_odds(k, values)
                    near = np.rint((odds + STRETCH_SPAN) * ((STRETCH_STEPS - 1) / (2 * STRETCH_SPAN)))
                    at = (1 << k | byte >> (8 - k)) * STRETCH_STEPS + near.astype(np.int64)
                    sums[1] += np.bincount(at, share * bit, sums.shape[1])
                    sums[0] += np.bincount(at, share * (1 - bit), sums.shape[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array([sums.tobytes()], pa.binary())], ["sums"]
        )

    sums = np.zeros((2, 256, STRETCH_STEPS))
    for row in strings.mapInArrow(work, "sums binary").toLocalIterator():
        sums += np.frombuffer(row["sums"]).reshape(sums.shape)
    # Where little was seen the odds stay as they are.
    own = np.linspace(-STRETCH_SPAN, STRETCH_SPAN, STRETCH_STEPS)
    share = 1 / (1 + np.exp(-own))
    return np.log((sums[1] + 4 * share) / (sums[0] + 4 * (1 - share)))


def learn(docs: DataFrame, text: str = "text") -> Model:
    """A model of all texts of ``docs``."""
    counted = cut_lineage(string_counts(docs, text))
    parts = pieces_for(counted.count(), TASK_STRINGS)
    # In the order of a hash no partition and no stretch of one is of one kind.
    order = F.xxhash64("string")
    strings = cut_lineage(counted.repartition(parts, order).sortWithinPartitions(order))
    tables = build_tables(strings)
    shared = docs.sparkSession.sparkContext.broadcast(tables)
    weights = learn_weights(strings, shared)
    last = learn_last(strings, shared, weights)
    shared.unpersist()
    return Model(tables, weights, last)


# ---- scores ----


def model_scores(model: Model, column: pa.Array) -> np.ndarray:
    """log10 of the probability of every text; equal strings are scored once."""
    strings, bounds = framed(*text_bytes(column))
    coded = pa.array(strings).dictionary_encode()
    cost = model.cost(coded.dictionary.to_numpy())
    each = cost[coded.indices.to_numpy()]
    return np.add.reduceat(each, bounds[:-1]) if len(each) else np.zeros(0)


def lower_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words with A-Z in lower case, and how many each row has."""
    data, offsets = text_bytes(column)
    blank = _BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = ~blank
    begins[1:] &= blank[:-1] | edge[1:-1]
    starts = np.flatnonzero(begins)
    kept = data[~blank]
    upper = (kept >= 65) & (kept <= 90)
    kept = np.where(upper, kept + 32, kept).astype(np.uint8)
    # Places of the starts among the bytes that are kept.
    places = np.append(np.cumsum(~blank)[starts] - 1, len(kept)).astype(np.int64)
    words = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(kept)]
    )
    return words, np.diff(np.searchsorted(starts, offsets))


_ROWS = pa.schema(
    [
        ("block", pa.int64()),
        ("word", pa.binary()),
        ("number", pa.int32()),
        ("n_train", pa.int64()),
        ("ids", pa.list_(pa.int64())),
        ("held", pa.list_(pa.bool_())),
        ("words", pa.list_(pa.int64())),
        ("bytes", pa.list_(pa.int64())),
        ("score", pa.list_(pa.float64())),
        ("distinct", pa.list_(pa.int32())),
        ("numbers", pa.binary()),
        ("times", pa.binary()),
    ]
)
_ROWS_DDL = (
    "block long, word binary, number int, n_train long, ids array<long>, held array<boolean>, "
    "words array<long>, bytes array<long>, score array<double>, distinct array<int>, "
    "numbers binary, times binary"
)

_SCORED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("held_out", pa.bool_()),
        ("n_tokens", pa.int64()),
        ("n_known", pa.int64()),
        ("train_tokens", pa.int64()),
        ("base_score", pa.float64()),
        ("score", pa.float64()),
        ("bits_per_byte", pa.float64()),
    ]
)


def _batch_rows(batch: pa.RecordBatch, block: int, model: Model):
    """A row for each distinct word, and one with the batch's documents."""
    n = batch.num_rows
    held = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
    words, per_row = lower_words(batch.column("text"))
    coded = words.dictionary_encode()
    number = coded.indices.to_numpy().astype(np.int64)
    kinds = len(coded.dictionary)
    row = np.repeat(np.arange(n), per_row)
    train = np.bincount(number[~held[row]], minlength=kinds)
    nulls = lambda name, count: pa.nulls(count, _ROWS.field(name).type)
    yield table(
        _ROWS,
        block=np.full(kinds, block),
        word=coded.dictionary.cast(pa.binary()),
        number=np.arange(kinds),
        n_train=train,
        **{name: nulls(name, kinds) for name in _ROWS.names[4:]},
    )
    keys, times = np.unique(row * max(kinds, 1) + number, return_counts=True)
    _, offsets = text_bytes(batch.column("text"))
    one = lambda values, name: pa.array([values], _ROWS.field(name).type)
    yield table(
        _ROWS,
        block=[block],
        word=nulls("word", 1),
        number=nulls("number", 1),
        n_train=nulls("n_train", 1),
        ids=one(batch.column("doc_id").to_pylist(), "ids"),
        held=one(held, "held"),
        words=one(per_row, "words"),
        bytes=one(np.diff(offsets), "bytes"),
        score=one(model_scores(model, batch.column("text")), "score"),
        distinct=one(np.bincount(keys // max(kinds, 1), minlength=n).astype(np.int32), "distinct"),
        numbers=one((keys % max(kinds, 1)).astype("<u4").tobytes(), "numbers"),
        times=one(times.astype("<u4").tobytes(), "times"),
    )


def scored(
    docs: DataFrame, model: Model, held: Column, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Base and model score of every row; ``held`` marks rows not learned from."""
    from pyspark import TaskContext

    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.tables, model.weights, model.last))

    def work(batches):
        mine = Model(*shared.value)
        block = TaskContext.get().partitionId() << 32
        for batch in chunks(batches, "text", CHUNK):
            yield from _batch_rows(batch, block, mine)
            block += 1

    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"), held.alias("held"), docs[text].alias("text")
    )
    stored = cut_lineage(rows.mapInArrow(work, _ROWS_DDL))
    words = stored.filter("word IS NOT NULL").select("block", "word", "number", "n_train")
    per_word = Window.partitionBy("word")
    answers = cut_lineage(
        words.select(
            "block",
            "number",
            F.sum("n_train").over(per_word).alias("c"),
            (F.row_number().over(per_word.orderBy("block")) == 1).alias("first"),
        )
    )
    kinds = answers.filter("first AND c > 0").count()
    batches = stored.filter("word IS NULL").drop("word", "number", "n_train")
    trained = words.agg(F.sum("n_train")).first()[0] or 0
    texts = batches.select(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0
    total = trained + texts
    norm = np.log10(float(total + kinds + (texts > 0) + 1))

    def finish(batch: pa.Table, found: pa.Table) -> pa.Table:
        if not batch.num_rows:
            return _SCORED.empty_table()
        entry = batch.to_pylist()[0]
        c = np.zeros(found.num_rows, np.int64)
        c[found.column("number").to_numpy()] = found.column("c").to_numpy()
        numbers, times = (np.frombuffer(entry[x], "<u4").astype(np.int64) for x in ("numbers", "times"))
        row = np.repeat(np.arange(len(entry["ids"])), entry["distinct"])
        n = len(entry["ids"])
        n_tokens = np.array(entry["words"], np.int64) + 1
        logs = np.bincount(row, times * np.log10(c[numbers] + 1.0), n) + np.log10(texts + 1.0)
        score = np.array(entry["score"])
        size = np.maximum(np.array(entry["bytes"]), 1)
        result = table(
            _SCORED,
            doc_id=pa.array(entry["ids"], pa.int64()),
            held_out=entry["held"],
            n_tokens=n_tokens,
            n_known=np.bincount(row, times * (c[numbers] > 0), n).astype(np.int64) + (texts > 0),
            train_tokens=np.full(n, total),
            base_score=logs - n_tokens * norm,
            score=score,
            bits_per_byte=-score * np.log2(10.0) / size,
        )
        return pa.Table.from_batches([result])

    return (
        batches.groupBy("block")
        .cogroup(answers.select("block", "number", "c").groupBy("block"))
        .applyInArrow(
            finish,
            "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
            "base_score double, score double, bits_per_byte double",
        )
    )
