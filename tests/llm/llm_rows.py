"""Rows that several test modules share."""

LONG = " ".join(f"word{i}" for i in range(6000))
CLASHING = ["block", "row", "place", "digest", "norm", "h1", "body", "rep", "n", "_keep", "key", "words", "score", "kept", "start", "ids", "value", "_id", "_gone"]

ODD = [
    (None, "A text without an id, long enough to be a line of its own."),
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "One line that many hold, for sure.\nsecond"),
    (5, "one line that many hold, for sure.  \nthird one here\nthird one here"),
    (5, "one line that many hold, for sure.  \nthird one here\nthird one here"),
    (6, LONG),
    (7, LONG + " end"),
    (8, "日本語のテキスト, naïve Ünïcode 😀 and   more"),
    (9, "12345 67890 !!! ???"),
    (10, "x"),
]


def rows_by_id(rows):
    return {r["doc_id"]: r for r in rows}
