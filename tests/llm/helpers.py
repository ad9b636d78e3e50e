"""Small tables with the rows that every operator has to take."""

from __future__ import annotations

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EXTRA = "id string, row int, keep boolean, tokens string, text_len int, _row string, label int, digest string, copy_no int"
LONG = "word salad with nothing in it, " * 40_000


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    return [
        (1, "Plain words, none of them alike at all.", "en", "a", 39),
        (1, "Plain words, none of them alike at all.", "en", "a", 39),
        (1, "Another text under the same number.", "en", "a", 35),
        (None, "Plain words, none of them alike at all.", None, None, None),
        (None, None, None, None, None),
        (2, None, "de", "a", 0),
        (3, "", "de", "b", 0),
        (4, " \n\t ", "fr", "b", 4),
        (5, LONG, "en", "b", len(LONG)),
        (6, "é日本́ \U0001f600 \0 x", "xx", None, 9),
        (7, "one", "en", "c", 3),
        (8, "one", "en", "c", 3),
        (9, "a\n\na\nb", "en", "c", 6),
    ]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def crowded(spark):
    """The same rows with columns named like what operators make."""
    names = [x.split()[0] for x in EXTRA.split(", ")]
    full = [r + ("x", 1, True, "t", 2, "r", 3, "d", 4) for r in odd_rows()]
    assert len(names) == 9
    return spark.createDataFrame(full, f"{SCHEMA}, {EXTRA}")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row) -> str:
    return repr(tuple(row))


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
