import pytest
from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Columns that bear names the operators use themselves.
        *[
            T.StructField(name, T.StringType())
            for name in "row kept h at block bin shard n_words tokens weight label key size".split()
        ],
    ]
)

PROSE = (
    "the quiet river of the north and the old bridge that was built in stone for the people "
    "of the town is seen by all who come with goods to the market on the hill as it was before "
)
FRENCH = (
    "la rivière du nord et le vieux pont que les gens de la ville ont construit en pierre pour le "
    "marché est vu par tous ceux qui viennent avec des chevaux dans une vallée très étroite "
)


def awkward_rows():
    edited = PROSE.replace("stone", "wood", 1)
    texts = [
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, " \t\n\x0b\x0c\r ", None, None),
        (4, "word", "en", "a"),
        (5, "a b c d", "en", "a"),
        (6, PROSE * 3, "en", "a"),
        (7, PROSE * 3, "en", "b"),
        (8, PROSE * 3, None, "a"),
        (9, PROSE * 2 + edited, "en", "a"),
        (10, FRENCH * 3, "fr", "a"),
        (11, "prefix " + FRENCH * 2 + "suffix", "fr", "b"),
        (12, "x" * 3000, "en", "a"),
        (13, "one two three " * 400, "en", "a"),
        (14, " ".join(f"w{k}x{k * k % 977}" for k in range(20_000)), "en", "a"),
        (15, "éàü   b　c  d   e\n\n\nf\u0085g <|endoftext|> \U0001f600 ǅ İ ﬁ", "fr", "a"),
        (16, "# * $ % & | < > " * 40, "en", "a"),
        (17, "line of the day\n" * 60, "en", "a"),
        (18, "123 456 !!! ...", "en", "a"),
        (None, PROSE * 3, "en", "a"),
        (None, None, None, None),
        (20, PROSE, "en", "a"),
        (20, PROSE, "en", "a"),
        (21, PROSE + FRENCH, "fr", "c"),
    ]
    junk = ["junk"] * (len(SCHEMA) - 5)
    return [(i, t, lang, s, len(t) if t else None, *junk) for i, t, lang, s in texts]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def small_rows(small):
    return [(r["doc_id"], r["text"]) for r in small.select("doc_id", "text").collect()]
