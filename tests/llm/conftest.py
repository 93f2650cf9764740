import pytest


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, clashing columns."""
    long_text = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))
    rows = [
        (1, "Some plain words to begin this small table with"),
        (1, "Some plain words to begin this small table with"),
        (1, "Other words under the very same id as before, you see"),
        (2, None),
        (3, ""),
        (4, " \n\t "),
        (None, "A text without any id that still has words enough"),
        (None, None),
        (5, long_text),
        (6, long_text + " and more"),
        (7, "one"),
        (8, "naïve ünïcödé 😀 text – with odd   spaces\r\nand lines"),
        (9, "Some plain words to begin this small table with"),
    ]
    extra = "at long, node string, h long, size string, shard string, lines string, removed string, score string, label long, tile long"
    names = [x.split()[0] for x in extra.split(", ")]
    wide = [r + tuple(None if i % 2 else (7 if x.endswith("long") else "x") for x in extra.split(", ")) for i, r in enumerate(rows)]
    frame = spark.createDataFrame(wide, f"doc_id long, text string, {extra}")
    assert frame.columns[2:] == names
    return frame, rows
