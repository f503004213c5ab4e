"""Spelling variants against all pairs of a small vocabulary."""

import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from tierflow.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows, noise=199):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    return counts


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(counts):
    forms = {}
    for w, n in counts.items():
        close = [x for x in counts if near(w, x)]
        best = min(close, key=lambda x: (-counts[x], x), default=None)
        forms[w] = (best if best and counts[best] >= 5 * n else None, len(close))

    def root(w):
        while forms[w][0]:
            w = forms[w][0]
        return w

    return sorted(
        (w, forms[w][0], root(w), n, forms[w][1], counts[forms[w][0]] if forms[w][0] else None)
        for w, n in counts.items()
    )


def rows_of(df):
    names = ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=lambda r: r[0])


def random_words(rng, letters, count):
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(6, 10))) for _ in range(count)}
    for w in list(words)[: count // 2]:
        k = rng.randrange(len(w) + 1)
        words.add(w[:k] + rng.choice(letters) + w[k:])
        words.add(w[:k] + rng.choice(letters) + w[k + 1 :])
    return {w: rng.choice([5, 6, 26, 150, 900, 30_000]) for w in words if len(w) >= 6}


@pytest.mark.parametrize("letters, count", [("ab", 250), ("abé", 400), ("abcdefgh", 300)])
@pytest.mark.parametrize("most", [spelling.GROUP_WORDS, 4])
def test_variants_are_those_of_all_pairs(spark, letters, count, most, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK_WORDS", 64)
    words = random_words(random.Random(count), letters, count)
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    assert rows_of(spelling.variants(df, most=most)) == plain_variants(words)


def test_words_of_one_group_that_end_where_others_go_on(spark):
    words = {"aaaaaa": 5, "aaaaaaa": 30, "aaaaaaaa": 200, "aaaaaab": 5, "baaaaaa": 7, "aaabaaa": 9, "x" * 3000: 5, "x" * 3001: 40}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    for most in (spelling.GROUP_WORDS, 1):
        assert rows_of(spelling.variants(df, most=most)) == plain_variants(words)


def test_counts_of_awkward_rows(spark, awkward, empty, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 50)
    rows = [(r["doc_id"], r["text"]) for r in awkward.select("doc_id", "text").collect()]
    for noise in (199, 3):
        ours = {r["word"]: r["n"] for r in spelling.count_words(awkward, noise=noise).collect()}
        assert ours == plain_counts(rows, noise)
    assert spelling.count_words(empty).count() == 0
    assert spelling.spelling_variants(empty).count() == 0


def test_letters_and_cases(spark):
    text = "ÀÉÎõüÿ×÷abc STRASSEN Straßen ſtraßen ĀBCDEFGHI x-ray's naïvetés ÉCOLIERS écoliers"
    docs = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    ours = {r["word"]: r["n"] for r in spelling.count_words(docs).collect()}
    assert ours == plain_counts([(1, text), (1, text), (None, text)])


def test_small_table(spark, small, small_rows):
    counts = {w: n for w, n in plain_counts(small_rows).items() if n >= 5}
    assert rows_of(spelling.spelling_variants(small)) == plain_variants(counts)


def test_frontier_of_one_word_at_a_time(monkeypatch):
    """The same pairs, however many words go down the list together."""
    words = sorted(random_words(random.Random(5), "abc", 60))
    group = [0] * len(words)
    import numpy as np

    sizes = np.full(len(words), 6)
    args = (pa.array(words), np.array(group), sizes, np.zeros(len(words), np.int64), np.full(len(words), 7))
    together = set(zip(*[x.tolist() for x in spelling.near_pairs(*args)]))
    monkeypatch.setattr(spelling, "SEARCH_WORDS", 1)
    assert together == set(zip(*[x.tolist() for x in spelling.near_pairs(*args)]))
    want = {
        (i, j) for i, a in enumerate(words) for j, b in enumerate(words)
        if near(a, b) and min(len(a), len(b)) <= 6
    }
    assert {p for p in together if min(len(words[p[0]]), len(words[p[1]])) == 6} == want
