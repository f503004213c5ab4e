"""Quality rules, language, fingerprints, near duplicates, repeated strings."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from plain import generalised_jaccard, jaccard_classes, removed_bytes, words
from pyspark.sql import functions as F

from tierflow.llm import fingerprints, langid, lsh_forest, quality, suffix


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# ---- quality rules ----


def plain_measures(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return (
        len(w),
        sum(map(len, w)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(hit),
    )


def test_quality_measures(awkward):
    rows = quality.judged(awkward.filter("doc_id <> 14 OR doc_id IS NULL")).collect()
    assert len(rows) == 22
    for r in rows:
        got = tuple(
            r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        )
        want = plain_measures(r["row"]["text"])
        assert got == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_quality_keeps_prose_and_columns(awkward, empty):
    kept = quality.keep_good(awkward)
    assert kept.columns == awkward.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == {14, 21} or ids == {21}
    assert quality.judged(empty).count() == 0


def test_quality_is_one_native_projection(small):
    plan = quality.judged(small)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Python", "Arrow"))


# ---- language ----


def test_language(awkward, empty):
    profiles = langid.learn(awkward)
    assert [n for n, _ in profiles] == ["en", "fr"]
    out = {r["doc_id"]: r for r in langid.predict(awkward, profiles, keep=("doc_id", "text")).collect()}
    assert out[6]["lang_pred"] == "en" and out[10]["lang_pred"] == "fr"
    for i in (1, 2, 3, 18):
        assert (out[i]["lang_pred"], out[i]["score"]) == ("und", 0.0)
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert langid.predict(empty, profiles, keep=("doc_id",)).count() == 0
    assert langid.learn(empty) == []
    nothing = langid.predict(awkward, [], keep=("doc_id",))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}


def test_ngrams_of_a_text():
    grams = langid.Grams(pa.array(["Ab c", None, "ab"]))
    owner, ids, n = grams.counted(np.arange(3))
    codes = grams.codes(ids)
    e, a, b, c = langid.EDGE, ord("a"), ord("b"), ord("c")
    code = lambda *x: sum(v << (21 * k) for k, v in enumerate(reversed(x)))
    want = {code(a), code(b), code(c), code(e, a), code(a, b), code(b, e), code(e, c), code(c, e)}
    want |= {code(e, a, b), code(a, b, e), code(e, c, e)}
    assert set(codes[owner == 0]) == want
    assert set(codes[owner == 2]) == {x for x in want if x in {
        code(a), code(b), code(e, a), code(a, b), code(b, e), code(e, a, b), code(a, b, e)}}
    assert not (owner == 1).any()


def test_language_held_out_accuracy(small):
    held = F.col("doc_id") % 5 == 0
    profiles = langid.learn(small.filter(~held))
    got = langid.predict(small.filter(held), profiles, keep=("lang",)).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)


# ---- fingerprints ----


def test_edited_texts(awkward):
    rows = fingerprints.compare_edited(awkward.filter("doc_id IS NOT NULL")).collect()
    texts = sorted(pairs(awkward.filter("doc_id IS NOT NULL")), key=lambda r: (r[0], r[1] or ""))
    got = sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows)
    want = []
    for (i, a), (_, b) in zip(texts, texts[1:] + texts[:1], strict=True):
        a, b = a or "", b or ""
        half = len(a) // 2
        edited = a[: len(a) - half] + b[:half]
        want.append((i, len(a), hashlib.sha256(edited.encode()).hexdigest()))
    assert got == sorted(want)
    marks = {r["doc_id"]: r["fingerprint"] for r in rows}
    assert marks[6] == marks[7] == marks[8] != marks[9]
    assert marks[1] == marks[2] == marks[3]


@pytest.mark.parametrize("block_bytes", [4_000, 1 << 30])
def test_blocks_do_not_change_fingerprints(small, small_rows, monkeypatch, block_bytes):
    whole = fingerprints.in_blocks
    monkeypatch.setattr(fingerprints, "in_blocks", lambda d: whole(d, block_bytes))
    monkeypatch.setattr(fingerprints, "CHUNK", 10_000)
    rows = {r["doc_id"]: r for r in fingerprints.compare_edited(small).collect()}
    ordered = sorted(small_rows)
    miss = []
    for (i, a), (_, b) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        half = len(a) // 2
        edited = a[: len(a) - half] + b[:half]
        assert rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        miss.append(rows[i]["near_edited"] - generalised_jaccard(a, edited))
        miss.append(rows[i]["near_next"] - generalised_jaccard(a, b))
    assert abs(np.mean(miss)) < 0.01 and np.std(miss) < 0.07


def test_collision_rate_follows_weights():
    a = "x " * 9 + "y " * 3 + "z"
    b = "x " * 3 + "y " * 9 + "q"
    marks, some = fingerprints.signatures(pa.array([a, b]), samples=4096)
    near = fingerprints.likeness(marks[:1], some[:1], marks[1:], some[1:])[0]
    assert abs(near - generalised_jaccard(a, b)) < 0.03


def test_fingerprints_of_nothing(empty, awkward):
    assert fingerprints.compare_edited(empty).count() == 0
    assert fingerprints.fingerprinted(awkward).count() == 23


# ---- near duplicates ----


def test_jaccard_join(small, small_rows):
    want = jaccard_classes(small_rows)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in lsh_forest.jaccard_join(small).collect()}
    assert got == want


def test_jaccard_join_awkward(awkward, empty):
    got = lsh_forest.jaccard_join(awkward).collect()
    assert len(got) == 23
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    want = jaccard_classes([r for r in pairs(awkward) if r[0] is not None])
    for i, (label, _) in want.items():
        assert by_id[i]["class_id"] == label, i
    assert by_id[6]["n_links"] >= 3 and by_id[1]["n_links"] == 0
    assert [r["class_id"] for r in got if r["doc_id"] is None] == [None, None]
    assert lsh_forest.jaccard_join(empty).count() == 0


def test_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lsh_forest, "BLOCK", 16)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(120):
        w = list(base)
        for k in range(i % 7):
            w[(i * 13 + k * 29) % 200] = f"n{i}_{k}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"u{i}_{k}" for k in range(60))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = jaccard_classes(rows)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in lsh_forest.jaccard_join(docs).collect()}
    assert got == want
    kept = lsh_forest.keep_first(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {c for c, _ in want.values()}


def test_depth_follows_recall():
    assert lsh_forest.depth_for(0.8, 28, 0.999) == 6
    assert lsh_forest.depth_for(0.8, 28, 0.9999) < 6 <= lsh_forest.depth_for(0.8, 28, 0.9)


# ---- repeated strings ----


def rows_of(df):
    return sorted(
        ((r[0], r[1], r[2], r[3], r[4]) for r in df.collect()), key=lambda r: (r[0] is None, r)
    )


@pytest.mark.parametrize("sizes", [(1 << 30, 1 << 30), (20_000, 50_000)])
def test_repeated_strings(small, small_rows, sizes):
    got = rows_of(suffix.remove_repeats(small, block_bytes=sizes[0], bucket_bytes=sizes[1]))
    assert got == sorted(removed_bytes(small_rows))


def test_repeated_strings_awkward(awkward, empty):
    got = rows_of(suffix.remove_repeats(awkward, block_bytes=5_000))
    want = removed_bytes(pairs(awkward))
    assert got == sorted(want, key=lambda r: (r[0] is None, r))
    assert suffix.remove_repeats(empty).count() == 0
    kept = suffix.without_repeats(awkward)
    assert kept.columns == awkward.columns
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert 7 not in texts and texts[6].startswith("the quiet") and texts[1] is None


def test_overlapping_and_short_matches(spark):
    core = "".join(chr(97 + (k * 7 + k // 5) % 26) for k in range(160))
    rows = [
        (1, core),
        (2, "Q" + core[10:60] + "Z"),
        (3, "Q" + core[10:59] + "Z"),
        (4, core[0:55] + core[40:110]),
        (5, "é" * 10 + core[100:160] + "é"),
        (6, "ab" * 80),
        (7, "ba" * 60),
        (8, core[:49]),
        (9, core[:50]),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(suffix.remove_repeats(docs, block_bytes=100, bucket_bytes=100))
    assert got == sorted(removed_bytes(rows))


def test_one_id_with_a_copy_and_another_text(spark):
    one = " ".join(f"a{k * k}" for k in range(40))
    other = " ".join(f"b{k * k + 1}" for k in range(40))
    rows = [(1, one), (5, one), (5, other), (6, "Z" + other[20:120] + "Q"), (7, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(suffix.remove_repeats(docs))
    assert got == sorted(removed_bytes(rows))
    kept = sorted((r["doc_id"], r["text"]) for r in suffix.without_repeats(docs).collect())
    assert kept == [(1, one), (5, other), (6, "ZQ")]


def test_merge_keeps_order_and_common_prefixes():
    rng = np.random.default_rng(3)
    rows = rng.integers(97, 99, (300, suffix.LENGTH)).astype(np.uint8)
    rows[50:90] = rows[:40]
    runs, parts = [], np.array_split(rows, 7)
    for part in [*parts, rows[:0]]:
        part = part[suffix.row_order(part)]
        lead = suffix.shared(part)
        tail = np.arange(suffix.LENGTH) >= lead[:, None]
        runs.append((lead.astype(np.uint8).tobytes(), part[tail].tobytes()))
    order, common = (x.tolist() for x in suffix.merge_runs(runs))
    ordered = rows[suffix.row_order(rows)]
    assert common == suffix.shared(ordered).tolist()
    assert [order.count(i) for i in range(8)] == [len(p) for p in parts] + [0]
