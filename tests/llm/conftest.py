import pytest

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside or add.
CLASHING = [
    "line", "pos", "h1", "h2", "key", "fp", "id", "t", "v", "words", "lines", "w", "l", "shard", "slot", "size", "virtual_slot", "score", "tokens", "passes",
    "left", "supply", "p", "ids", "spans", "first", "N_Lines", "n_dropped", "mix_copies", "Mix_Tokens", "kept", "asks", "d", "rb", "row", "hash", "copy", "n",
    "__id", "__lines", "__text_hash", "__drops", "__source", "__hash", "__left", "__passes", "__kept", "__node", "__least", "__text", "__label", "found_id",
    "use", "node", "least", "band", "k", "a", "b", "component", "hash_", "dotted.name",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, equal texts, white space only."""
    long = " ".join(f"word{i % 997} tail{i % 31}" for i in range(60_000)) + "\n" + "x" * 200_000
    rows = [
        (5, "A shared line of text.\nonly here, five", "en", "s1", 10), (3, "a shared line of text. \nother words in three", "en", "s2", 10),
        (3, "a shared line of text. \nother words in three", "en", "s2", 10), (None, "A SHARED LINE OF TEXT.", None, None, None), (None, None, None, None, None),
        (7, None, "en", "s1", None), (8, "", "en", "s1", 0), (9, " \t\n ", "de", None, 4), (10, long, "en", "s3", len(long)), (11, "short", "en", "s1", 5),
        (12, "short", "en", "s1", 5), (13, "héllo wörld 日本 😀 <|endoftext|> it's", "fr", "s2", 20),
    ]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def clashing(odd):
    from pyspark.sql import functions as F

    return odd.select("*", *[F.lit(c).alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
