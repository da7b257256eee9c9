import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    return SMALL


def rows_of(spark, name, columns):
    return spark.read.parquet(f"{SMALL}/{name}.parquet").select(*columns).collect()


@pytest.fixture(scope="session")
def documents(spark):
    return rows_of(spark, "documents", ["doc_id", "text", "source"])


TABLES = {
    "documents": (
        "doc_id long, text string, lang string, source string, n_chars long, size int, row_key string, extra map<string,int>",
        [
            (1, "a b c d idiot. x", None, "s", 3, 5, "k", {"a": 1}),
            (1, "a b c d idiot. x", None, "s", 3, 5, "k", {"a": 1}),
            (None, None, "en", None, 0, 1, None, None),
            (None, "", None, "é", 0, 1, None, None),
            (2, "same words here now one two three four five six seven", "en", "s", 1, 1, "", {}),
            (3, "same words here now one two three four five six seven", "en", "t", 1, 2, "", None),
            (4, "word " * 50_000, "en", "t", 1, 2, "", None),
        ],
    ),
    "labels": ("doc_id long, quality int, toxic int", [(1, 1, 1), (2, 0, None), (None, 1, 1)]),
    "benchmark": (
        "item_id long, text string",
        [(1, "Same words here now one two three four five six"), (2, None), (None, "a b c"), (3, "!!")],
    ),
    "pages": ("page_id long, url string, html string", [(1, None, None), (None, "u", ""), (3, "u", "<p>hi &amp; x")]),
    "conversations": (
        "conv_id long, turn long, role string, text string",
        [(1, 0, "user", "hi"), (1, 1, None, None), (None, None, "user", ""), (1, 1, "assistant", "x")],
    ),
    "embeddings": (
        "vec_id long, embedding array<float>, label int",
        [
            (0, [1.0, 0.0], 1),
            (20, [0.0, 0.0], 1),
            (1, [0.5, float("nan")], 1),
            (2, None, 1),
            (3, [1.0, 0.0], 1),
            (4, [0.5, 0.5], 1),
            (40, [None, 1.0], 1),
            (60, [2.0, 1.0], 1),
            (None, [1.0, 1.0], 1),
        ],
    ),
}


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """Nulls, ties, repeated rows, long texts, clashing extra columns."""
    folder = tmp_path_factory.mktemp("odd")
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name, (schema, _) in TABLES.items():
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
