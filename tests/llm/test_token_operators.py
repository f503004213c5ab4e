"""Token files, packing, sharding, scores, mixing and the pipeline."""

import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plain import crc, jaccard_classes, removed_bytes, unigram, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tierflow.llm import lm, mixing, packing, quality, queries, sharding, token_store
from tierflow.llm.encoding import Encoder
from tierflow.llm.tables import tokenizer_path

WORDS_49K, BYTES_50K = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")


def encoded(path, rows, end):
    tokenizer = Tokenizer.from_file(path)
    return [
        (i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, end]) for i, t in rows
    ]


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# ---- encoding ----

ODD = st.text(alphabet=st.sampled_from("ab's1! \n\t\r\x0b\x1c\x85   　é́<|>İ😀中"), max_size=40)


@pytest.mark.parametrize("path", [WORDS_49K, BYTES_50K])
def test_parts_give_the_ids_of_the_text(path):
    encoder = Encoder(path)

    @settings(max_examples=150, deadline=None)
    @given(st.lists(ODD, max_size=5))
    def same(texts):
        ids, bounds = encoder.encode(pa.array(texts, pa.string()))
        for (_, want), a, b in zip(
            encoded(path, enumerate(texts), 0), bounds[:-1], bounds[1:], strict=True
        ):
            assert ids[a:b].tolist() == want[:-1]

    same()


# ---- token files ----


def test_token_store_round_trip(spark, awkward, tmp_path):
    folder = f"file://{tmp_path}/store"
    token_store.write_store(awkward, folder, WORDS_49K, end=1, width=2)
    places = token_store.all_places(spark, folder)
    got = token_store.read_documents(spark, folder, places, width=2).collect()
    rows = sorted(pairs(awkward), key=lambda r: (r[0] is not None, r[0] or 0))
    want = Counter((i, len(ids), crc(ids)) for i, ids in encoded(WORDS_49K, rows, 1))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    # Documents stand one after another in the order of their keys.
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"]) if r["doc_id"] is not None]
    assert ids == sorted(ids)
    files = list(Path(f"{tmp_path}/store/payload").iterdir())
    assert sum(f.stat().st_size for f in files) == 2 * at


def test_index_leads_to_known_keys_only(spark, small, tmp_path):
    folder = f"file://{tmp_path}/store"
    token_store.write_store(small, folder, WORDS_49K, end=1, width=4)
    keys = spark.createDataFrame([(i,) for i in (3, 5, 3, -7, 10**12, None)], "doc_id long")
    found = token_store.lookup(spark, folder, keys).collect()
    assert {r["doc_id"] for r in found} == {3, 5} and len(found) == 2


def test_empty_store(spark, empty, tmp_path):
    folder = f"file://{tmp_path}/store"
    token_store.write_store(empty, folder, WORDS_49K, end=1, width=2)
    places = token_store.all_places(spark, folder)
    assert token_store.read_documents(spark, folder, places, width=2).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=400))
def test_minimal_perfect_hash(keys):
    names = np.array(sorted(keys), np.uint64)
    levels = token_store.build_hash(names)
    sizes, data = token_store._pack(levels)
    value = token_store.hash_value(token_store._unpack(sizes, data), names)
    assert sorted(value.tolist()) == list(range(len(keys)))


# ---- packing ----


def check_packed(rows, want, size):
    by_doc = defaultdict(list)
    by_sequence = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, ids in want:
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        at = 0
        for k, r in enumerate(parts):
            assert (r["piece"], r["start"]) == (k, at)
            assert r["ids_crc32"] == crc(ids[at : at + r["length"]])
            assert k == 0 or r["length"] == size
            at += r["length"]
        assert at == len(ids) and (len(ids) > size or len(parts) == 1)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    return len(by_sequence)


def test_packing(small, small_rows):
    rows = packing.pack(packing.token_pieces(small, BYTES_50K, end=0)).collect()
    want = encoded(BYTES_50K, small_rows, 0)
    used = check_packed(rows, want, packing.SEQUENCE)
    least = -(-sum(len(ids) for _, ids in want) // packing.SEQUENCE)
    assert used <= least * 1.02 + 1


def test_packing_awkward(awkward, empty):
    unique = awkward.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = packing.pack(packing.token_pieces(unique, BYTES_50K, end=0), group_tokens=5_000).collect()
    check_packed(rows, encoded(BYTES_50K, pairs(unique), 0), packing.SEQUENCE)
    everything = packing.pack(packing.token_pieces(awkward, BYTES_50K, end=0))
    assert everything.filter("doc_id IS NULL").count() == 2
    assert everything.filter("doc_id = 20").count() == 2
    assert packing.pack(packing.token_pieces(empty, BYTES_50K, end=0)).count() == 0


def test_sequences_hold_the_ids(small, small_rows):
    pieces = packing.token_pieces(small, BYTES_50K, end=0, size=512, with_ids=True)
    packed = packing.pack(pieces, size=512)
    rows = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    want = dict(encoded(BYTES_50K, small_rows, 0))
    for r in packed.drop("ids").collect():
        got = rows[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        assert got == want[r["doc_id"]][r["start"] : r["start"] + r["length"]]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80), st.integers(1, 6))
def test_best_fit_with_few_open_bins(lengths, open_bins):
    placed = list(packing.best_fit(lengths, 64, open_bins))
    # The same rule over a plain list of open sequences.
    opened, made = [], 0
    for length, (number, offset) in zip(lengths, placed, strict=True):
        fitting = [b for b in opened if b[1] >= length]
        if fitting:
            least = min(b[1] for b in fitting)
            mine = next(b for b in opened if b[0] == number)
            assert mine[1] == least and offset == 64 - least
        else:
            assert (number, offset) == (made, 0)
            if len(opened) >= open_bins:
                least = min(b[1] for b in opened)
                opened.remove([b for b in opened if b[1] == least][-1])
            mine = [made, 64]
            opened.append(mine)
            made += 1
        mine[1] -= length
        opened.remove(mine)
        if mine[1]:
            opened.append(mine)


# ---- sharding ----


def check_shards(rows, count):
    per = defaultdict(list)
    for r in rows:
        per[r["shard"]].append(r)
    for part in per.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    assert set(per) <= set(range(count))
    return [sum(r["size"] for r in per[s]) for s in range(count)]


def test_shards(small, small_rows):
    rows = sharding.shard_by_bytes(small, 10).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {
        i: (len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in small_rows
    }
    sums = check_shards(rows, 10)
    largest = max(r["size"] for r in rows)
    assert max(sums) - min(sums) <= 2 * largest


def test_shards_split_a_hot_text(spark):
    rows = [(i, "same text") for i in range(900)] + [(900 + i, f"text {i}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.shard_by_bytes(docs, 8, bin_bytes=1_000).collect()
    sums = check_shards(out, 8)
    assert max(sums) - min(sums) <= 0.03 * sum(sums) / 8
    same = sharding.shard_by_bytes(docs, 8).collect()
    hot = {r["shard"] for r in same if r["doc_id"] < 900}
    assert max(hot) - min(hot) + 1 == len(hot)


def test_small_groups_stay_together(spark):
    rows = [(i, f"text {i // 3}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.shard_by_bytes(docs, 8).collect()
    shards = defaultdict(set)
    for r in out:
        shards[r["doc_id"] // 3].add(r["shard"])
    assert max(len(s) for s in shards.values()) == 1


def test_shards_awkward(awkward, empty):
    rows = sharding.shard_by_bytes(awkward, 4).collect()
    assert len(rows) == 23
    check_shards(rows, 4)
    assert [r["size"] for r in rows if r["doc_id"] == 1] == [16]
    assert sharding.shard_by_bytes(empty, 4).count() == 0


# ---- scores ----


def test_scores(small, small_rows):
    held = queries.fold(F.col("doc_id"), 7) == 2
    model = lm.learn(small.filter(~held))
    rows = {r["doc_id"]: r for r in lm.scored(small, model, held).collect()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in small_rows}
    for i, (n, known, total, base) in unigram(small_rows, out).items():
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (
            out[i],
            n,
            known,
            total,
        )
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
    # Held-out text costs less than with any one order, and far less than bytes.
    texts = [t for i, t in small_rows if out[i]]
    size = sum(len(t.encode()) for t in texts)
    bits = -sum(rows[i]["score"] for i, _ in small_rows if out[i]) * np.log2(10) / size
    assert bits < 3
    for order in range(lm.ORDERS):
        weights = np.zeros((8, lm.ORDERS, lm.LEVELS))
        weights[:, order] = 1
        one = lm.model_scores(lm.Model(model.tables, weights), pa.array(texts))
        assert bits < -one.sum() * np.log2(10) / size


def test_model_is_a_distribution(small):
    model = lm.learn(small.limit(50))
    for context in ("", "th", "an ", "é"):
        data = np.frombuffer(context.encode(), np.uint8)
        last = np.frombuffer((b"\xfe" * 5 + context.encode())[-5:] + b"\0\0\0", "<u8")[0]
        strings = np.array([int(last) | b << 40 for b in range(256)], np.uint64)
        assert abs((10 ** model.cost(strings)).sum() - 1) < 1e-6
        strings_, bounds = lm.framed(data, np.array([0, len(data)]))
        assert len(strings_) == len(data) + 1 and bounds.tolist() == [0, len(data) + 1]


def test_scores_awkward(awkward, empty):
    held = F.col("doc_id") == 21
    model = lm.learn(awkward.filter(~F.coalesce(held, F.lit(False))))
    rows = lm.scored(awkward, model, F.coalesce(held, F.lit(False))).collect()
    assert len(rows) == 23
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["n_tokens"] == 1 and by_id[1]["score"] == by_id[2]["score"] < 0
    assert by_id[6]["score"] == by_id[7]["score"] == by_id[8]["score"]
    plain = lm.learn(empty)
    assert lm.scored(empty, plain, F.lit(False)).count() == 0
    even = {r["doc_id"]: r for r in lm.scored(awkward, plain, F.lit(True)).collect()}
    assert even[6]["n_known"] == 0 and even[6]["base_score"] == 0
    assert abs(even[4]["score"] + 5 * 8 * np.log10(2)) < 1e-9


def test_small_counts_lose_one():
    n0, n1 = np.meshgrid(np.arange(8), np.arange(8))
    n0, n1 = n0.ravel(), n1.ravel()
    values = lm.slot_values(n0, n1).astype(np.int64)
    less = lm.without_one()
    has = n1 > 0
    assert (less[1][values[has] + (1 << 15)] == lm.slot_values(n0[has], n1[has] - 1)).all()
    has = n0 > 0
    assert (less[0][values[has] + (1 << 15)] == lm.slot_values(n0[has] - 1, n1[has])).all()


def test_rare_strings_count_beside_frequent_ones(spark):
    often, last = 1 << 24, 97 << 40
    rows = spark.range(0, 600_000, 1, 1).selectExpr(
        f"CASE WHEN id = 1 THEN {195 << 40} ELSE {last} + id END AS string",
        f"CASE WHEN id < 2 THEN {often}L ELSE 1L END AS n",
    )
    first = lm.slots(np.array([last], np.uint64), 0, lm.TABLE_BITS[0])[0]
    want = lm.slot_values(np.array([often + 599_998]), np.array([often]))
    assert lm.build_tables(rows)[0][first] == want


# ---- mixing ----


def test_raking_meets_its_targets(spark):
    rng = np.random.default_rng(5)
    cells = [(f"a{i}", f"b{j}", f"c{k}", int(rng.integers(1, 1000))) for i in range(5) for j in range(4) for k in range(3)]
    df = spark.createDataFrame(cells, "x string, y string, z string, tokens long")
    goals = {"x": [0.4, 0.3, 0.1, 0.1, 0.1], "y": [0.1, 0.2, 0.3, 0.4], "z": [0.5, 0.25, 0.25]}
    targets = {
        d: spark.createDataFrame([(f"{'abc'['xyz'.index(d)]}{i}", s) for i, s in enumerate(g)], "category string, share double")
        for d, g in goals.items()
    }
    got = mixing.rake(df, targets).collect()
    total = sum(r["tokens"] for r in got)
    for d, g in goals.items():
        for i, share in enumerate(g):
            name = f"{'abc'['xyz'.index(d)]}{i}"
            assert abs(sum(r["weight"] for r in got if r[d] == name) / total - share) < 1e-8
    # Raking keeps the odds ratios of the table.
    w = {(r["x"], r["y"], r["z"]): (r["weight"], r["tokens"]) for r in got}
    ratio = lambda k: (
        w["a0", "b0", "c0"][k] * w["a1", "b1", "c0"][k] / (w["a0", "b1", "c0"][k] * w["a1", "b0", "c0"][k])
    )
    assert abs(ratio(0) / ratio(1) - 1) < 1e-6


def test_targets_that_contradict_the_cells(spark):
    df = spark.createDataFrame([("a", "c", 5), ("b", "d", 5)], "x string, y string, tokens long")
    goal = lambda *rows: spark.createDataFrame(rows, "category string, share double")
    with pytest.raises(ValueError):
        mixing.rake(df, {"x": goal(("a", 0.5), ("b", 0.5)), "y": goal(("c", 0.9), ("d", 0.1))}, max_sweeps=10)


def test_slow_raking_is_told_from_contradiction(spark):
    tokens = [[1e9, 1e3], [2e8, 0], [0, 3e8], [0, 5e7]]
    cells = [(f"s{i}", f"l{j}", int(n)) for i, row in enumerate(tokens) for j, n in enumerate(row) if n]
    df = spark.createDataFrame(cells, "x string, y string, tokens long")
    targets = {d: mixing.tempered(df, d, 0.9) for d in "xy"}
    rows = mixing.rake(df, targets, strict=False).collect()
    total = sum(n for *_, n in cells)
    for d in "xy":
        for r in targets[d].collect():
            held = sum(c["weight"] for c in rows if c[d] == r["category"])
            assert abs(held / total - r["share"]) < 1e-8
    assert {r["state"] for r in rows} == {"met"}
    assert rows[0]["sweeps"] > 0 and max(rows[0]["miss"]) < 1e-8
    goal = lambda *rows: spark.createDataFrame(rows, "category string, share double")
    apart = spark.createDataFrame([("a", "c", 5), ("b", "d", 5)], "x string, y string, tokens long")
    never = {"x": goal(("a", 0.5), ("b", 0.5)), "y": goal(("c", 0.9), ("d", 0.1))}
    rows = mixing.rake(apart, never, strict=False).collect()
    assert {r["state"] for r in rows} == {"contradictory"}
    assert abs(rows[0]["miss"]["x"] - 0.4) < 1e-9 and rows[0]["miss"]["y"] < 1e-9


def test_mixture_awkward(awkward, empty):
    rows = mixing.mixture(awkward).collect()
    assert len(rows) == 23
    for r in rows:
        n = len(words(r["row"]["text"]))
        assert r["n_tokens"] == n
        assert (r["factor"] > 0) == (r["probability"] > 0) == (n > 0)
        assert r["probability"] <= 1 and (n or not r["kept"])
    assert max(r["probability"] for r in rows) == 1
    kept = mixing.keep_sampled(awkward)
    assert kept.columns == awkward.columns
    assert mixing.keep_sampled(empty).count() == 0


def test_mixture_is_native(small):
    plan = mixing.mixture(small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- pipeline ----


def test_pipeline_stages(spark, small):
    docs = small
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = pairs(docs)
        out = stage(spark, docs, "")
        assert out.columns == small.columns
        rows = pairs(out)
        if name == "quality rules":
            judged = {r["row"]["doc_id"] for r in quality.judged(docs).filter("kept").collect()}
            assert {i for i, _ in rows} == judged
        elif name == "n-gram jaccard join":
            classes = jaccard_classes(before)
            assert {i for i, _ in rows} == {c for c, _ in classes.values()}
        elif name == "suffix-array dedup":
            left = {i: n - gone for i, n, gone, *_ in removed_bytes(before)}
            assert {i for i, _ in rows} == {i for i, n in left.items() if n}
            assert all(len(t.encode()) <= left[i] for i, t in rows)
        docs = spark.createDataFrame(out.collect(), small.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    check_packed(packed, encoded(BYTES_50K, pairs(docs), 0), packing.SEQUENCE)


def test_pipeline_awkward(spark, awkward, empty):
    for start in (awkward, empty):
        docs = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "")
            assert docs.columns == start.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_librarys_on_special_names(name):
    """Parts encoded one by one against whole texts, names of special tokens among them."""
    parts = [" ", "  ", "\n", "\t", "a", "Hello", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "é", "'s", "1", "!", "\u00a0"]
    rng = random.Random(1)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(1000)]
    library = Tokenizer.from_file(tokenizer_path(name))
    ids, bounds = Encoder(tokenizer_path(name)).encode(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids


def test_encoder_forgets_parts_but_no_ids(monkeypatch):
    from tierflow.llm import encoding

    monkeypatch.setattr(encoding, "CACHED_PARTS", 20)
    small = encoding.Encoder(tokenizer_path("byte_bpe_50k.json"))
    for k in range(12):
        texts = [f"common words w{k * 10 + i} v{i}" for i in range(10)]
        ids, bounds = small.encode(pa.array(texts))
        for i, text in enumerate(texts):
            want = small.tokenizer.encode(text, add_special_tokens=False).ids
            assert ids[bounds[i] : bounds[i + 1]].tolist() == want
        # A generation is left when it is full; what it met last is kept once more.
        assert len(small.known) <= 20 + 32 and len(small.older) <= 20 + 32
    assert b"common" in small.known and b" w1" not in {**small.known, **small.older}


PIECES = st.sampled_from(
    [" ", "\n", "\t", "\x0b", "a", "Word", "É", "ß", "ÿ", "×", "÷", "ñ", "e\u0301", "=\u0338", "…", "中", "1", "'s", "'", "µ",
     *"!\"#$%&()*+,-./:;=?@|<>_", "<|endoftext|>", "<|startoftext|>", "|endoftext|>"]
)


@pytest.mark.parametrize("path", [WORDS_49K, BYTES_50K])
def test_ids_are_the_librarys_beside_marks(path):
    """Cuts before marks, and words encoded as one text, against whole texts."""
    encoder = Encoder(path)
    library = Tokenizer.from_file(path)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.lists(PIECES, max_size=25).map("".join), max_size=5))
    def same(texts):
        ids, bounds = encoder.encode(pa.array(texts, pa.string()))
        for i, text in enumerate(texts):
            want = library.encode(text, add_special_tokens=False).ids
            assert ids[bounds[i] : bounds[i + 1]].tolist() == want

    same()


@pytest.mark.parametrize("path", [WORDS_49K, BYTES_50K])
def test_encoder_remembers_a_word_once_beside_marks(path):
    encoder = Encoder(path)
    encoder.encode(pa.array(["cat cat, cat. été cat! été; cat's cat", None, ""]))
    assert set(encoder.known) == {b"cat", b" cat", b",", b".", b"!", b";", " été".encode(), b" cat's"}


def test_words_are_encoded_many_at_a_time(monkeypatch):
    encoder = Encoder(WORDS_49K)
    asked = []
    one = encoder._encode
    monkeypatch.setattr(encoder, "_encode", lambda texts: asked.append(len(texts)) or one(texts))
    texts = [f"{a}{b}{c} {a}{c}é," for a in "abcxyz" for b in "abcxyz" for c in "ABCXYZ"]
    ids, bounds = encoder.encode(pa.array(texts))
    assert asked == [1, 1]
    for (_, want), a, b in zip(encoded(WORDS_49K, enumerate(texts), 0), bounds[:-1], bounds[1:], strict=True):
        assert ids[a:b].tolist() == want[:-1]
