"""Language by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams (one to
three letters, with a mark at the edges of words).  A document's own most
frequent n-grams are compared to every profile by the out-of-place distance:
the sum of rank differences, with a fixed penalty for n-grams the profile
lacks.  Profiles have ``PROFILE`` entries per language, so what reaches the
driver and the tasks is bounded by the number of languages.

N-grams are counted per batch inside tasks and summed by (language, n-gram)
after that, so one frequent language or n-gram adds a row per batch at most.

Defined results: ``und`` with score 0 for a null text, a text without a letter,
or if nothing could be learned; ties between languages go to the first in
alphabetical order, ties between n-grams to the smaller code; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tierflow.llm.columnar import chunks, table, text_bytes

PROFILE = 300
UNKNOWN = "und"
# Bits of a code point in an n-gram's code, and the mark of a word's edge.
BITS, EDGE = 21, 1
CHUNK = 2 << 20


@cache
def _letters() -> np.ndarray:
    """The lower-case letter of every code point, the edge mark for others."""
    out = np.full(0x110000, EDGE, np.int32)
    for code in range(0x110000):
        if not 0xD800 <= code < 0xE000 and chr(code).isalpha():
            out[code] = ord(chr(code).lower()[0])
    return out


class Grams:
    """All n-grams of a batch of texts: the row and a small id of each."""

    def __init__(self, column: pa.Array):
        data, offsets = text_bytes(column)
        texts = [
            data[a:b].tobytes().decode("utf-8", "replace")
            for a, b in zip(offsets[:-1], offsets[1:], strict=True)
        ]
        self.count = len(texts)
        points = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le"), np.uint32)
        # The blank before a text belongs to its row, the last one to the last row.
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        lengths[-1] += 1
        rows = np.repeat(np.arange(self.count), lengths)
        letters = _letters()[points]
        seen = np.zeros(0x110000, bool)
        seen[letters] = True
        self.alphabet = np.flatnonzero(seen)
        self.bits = max(1, int(len(self.alphabet)).bit_length())
        place = np.zeros(0x110000, np.int64)
        place[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        at = place[letters]
        word = letters != EDGE
        pair = word[:-1] | word[1:]
        triple = word[1:-1]
        pairs = at[:-1] << self.bits | at[1:]
        self.ids = np.concatenate(
            [
                at[word],
                pairs[pair],
                (pairs[:-1] << self.bits | at[2:])[triple],
            ]
        )
        # A pair belongs to the row of its letter, a triple to that of its middle.
        pair_rows = np.where(word[:-1], rows[:-1], rows[1:])
        self.rows = np.concatenate([rows[word], pair_rows[pair], rows[1:-1][triple]])
        self.letters = np.bincount(rows[word], minlength=self.count)

    def codes(self, ids: np.ndarray) -> np.ndarray:
        """Codes that mean the same n-gram in every batch."""
        points = np.concatenate([[0], self.alphabet])
        mask = (1 << self.bits) - 1
        code = np.zeros(len(ids), np.int64)
        for k in (2, 1, 0):
            code = code << BITS | points[(ids >> (k * self.bits)) & mask]
        return code

    def counted(self, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owner, id, count) for the n-grams of rows with ``owners`` >= 0."""
        owner = owners[self.rows]
        mine = owner >= 0
        owner, ids = owner[mine], self.ids[mine]
        if not len(ids):
            return ids, ids, ids
        room = 3 * self.bits
        if room + int(owner.max()).bit_length() <= 63:
            keys, counts = np.unique(owner << room | ids, return_counts=True)
            return keys >> room, keys & ((1 << room) - 1), counts
        small, ids = np.unique(ids, return_inverse=True)
        keys, counts = np.unique(owner * len(small) + ids, return_counts=True)
        return keys // len(small), small[keys % len(small)], counts


LEARNED = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())])


def learn(
    docs: DataFrame, lang: str = "lang", text: str = "text", size: int = PROFILE
) -> list[tuple[str, list[int]]]:
    """(language, n-gram codes by rank), alphabetical by language."""

    def count(batches):
        for batch in chunks(batches, "text", CHUNK):
            names = batch.column("lang").dictionary_encode()
            grams = Grams(batch.column("text"))
            owner, ids, n = grams.counted(np.asarray(names.indices, dtype=np.int64))
            yield table(
                LEARNED,
                lang=names.dictionary.take(pa.array(owner)),
                code=grams.codes(ids),
                n=n,
            )

    counts = (
        docs.select(docs[lang].cast("string").alias("lang"), docs[text].alias("text"))
        .dropna()
        .mapInArrow(count, "lang string, code long, n long")
        .groupBy("lang", "code")
        .agg(F.sum("n").alias("n"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    ranked = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)
    profiles: dict[str, list[int]] = {}
    for row in sorted(ranked.collect(), key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(row["lang"], []).append(row["code"])
    return sorted(profiles.items())


def predict(
    docs: DataFrame,
    profiles: list[tuple[str, list[int]]],
    text: str = "text",
    keep: tuple[str, ...] = (),
    size: int = PROFILE,
) -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score`` for every row.

    The score is one less the best distance over the largest possible one.
    """
    known = np.unique(np.array([c for _, p in profiles for c in p], np.int64))
    ranks = np.full((len(profiles), len(known) + 1), -1, np.int64)
    for i, (_, codes) in enumerate(profiles):
        ranks[i, np.searchsorted(known, codes)] = np.arange(len(codes))
    names = pa.array([name for name, _ in profiles] + [UNKNOWN], pa.string())

    def compare(batches):
        for batch in chunks(batches, "__text", CHUNK):
            n = batch.num_rows
            grams = Grams(batch.column("__text"))
            row, ids, count = grams.counted(np.arange(n))
            code = grams.codes(ids)
            order = np.lexsort((code, -count, row))
            row, code = row[order], code[order]
            starts = np.searchsorted(row, np.arange(n + 1))
            rank = np.arange(len(row)) - starts[row]
            top = rank < size
            row, code, rank = row[top], code[top], rank[top]
            at = np.searchsorted(known, code)
            at[at == len(known)] = 0
            if len(known):
                at[known[at] != code] = len(known)
            grams_used = np.bincount(row, minlength=n)
            away = np.zeros((len(profiles), n))
            for i in range(len(profiles)):
                other = ranks[i, at]
                far = np.where(other < 0, size, np.abs(other - rank))
                away[i] = np.bincount(row, weights=far, minlength=n)
            pred = np.full(n, len(profiles))
            score = np.zeros(n)
            if len(profiles):
                some = grams.letters > 0
                best = away.argmin(axis=0)
                pred[some] = best[some]
                most = np.maximum(grams_used * size, 1)
                score[some] = (1 - away.min(axis=0) / most)[some]
            result = batch.drop_columns("__text")
            result = result.append_column("lang_pred", names.take(pa.array(pred)))
            yield result.append_column("score", pa.array(score))

    rows = docs.select(*[docs[c] for c in keep], docs[text].alias("__text"))
    schema = "".join(f"`{c}` {t}, " for c, t in rows.dtypes[:-1])
    return rows.mapInArrow(compare, schema + "lang_pred string, score double")
