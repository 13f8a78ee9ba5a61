"""Rows that operators must bear: nulls, empty and long texts, repeated rows."""

LONG = " ".join(f"word{i % 977} tail{i}" for i in range(30_000))
COPY = "The quick brown fox jumps over the lazy dog while seven other foxes look on from the hill above the river bend today."
ROWS = [
    (1, "a b c d e f g h i j\nThis line is long enough to be compared by edits.\n\nshort"),
    (2, "a b c d e f g h i j\nThis line is long enough to be compared by edit5.\n\nshort"),
    (2, "a b c d e f g h i j\nThis line is long enough to be compared by edit5.\n\nshort"),
    (3, ""),
    (4, None),
    (5, " \t\n\r\n "),
    (6, LONG),
    (7, LONG + " end"),
    (8, COPY),
    (9, COPY),
    (None, COPY),
    (None, None),
    (10, "wörter über größe 日本語 😀 \x00 é́ Licensed under CC BY-NC 4.0."),
    (11, "one"),
    (-5, COPY.upper()),
]
