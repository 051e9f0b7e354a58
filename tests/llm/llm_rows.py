"""Small tables with the cases that every operator must stand."""

import pytest

#: Null and empty texts, ties, repeated rows, text beyond the basic plane, one very long text.
ROWS = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "Hello  World, the 2nd line\nand <|endoftext|> 'll don't   x"),
    (6, "漢字かな交じり文 🙂🙂 Ⅷ ½ é é"), (7, "the quick brown fox jumps over the lazy dog and runs away from it all"),
    (8, "the quick brown fox jumps over the lazy dog and runs away from it all"), (9, "a" * 5000), (10, "word " * 9000 + "end"),
    (11, "the quick brown fox jumps over the lazy dog and runs away from it now"), (11, "the quick brown fox jumps over the lazy dog and runs away from it now"), (None, "a row without an id, of some words"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """With extra columns whose names clash with those that the operators add."""
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in ROWS], "doc_id long, text string, ids string, Score int, `a.b` string").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


def write(spark, path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)
