"""Small tables with every odd case, and comparison helpers."""

from __future__ import annotations

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, size long"


def prose(seed: int, n: int) -> str:
    return " ".join(f"{'abcdefgh'[(seed * 7 + i * i) % 8]}o{(seed * 31 + i * 17) % 211}" for i in range(n))


def odd_documents(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and clashing column names."""
    base = prose(1, 60)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, base.upper(), "en", "b"), (4, base + " tail", "en", "b"),
        (5, None, "en", "a"), (6, "", "en", None), (7, " \t\n ", None, "a"), (8, "one two", "en", "b"), (9, "ONE  two", "en", "b"),
        (10, LONG, "en", "a"), (None, base, "en", "a"), (11, prose(2, 40), None, None), (12, "é&<a>\n\né&<a>\nx", "xx", "c"), (13, prose(3, 300), "de", "c"),
    ]
    return spark.createDataFrame([(*r, 0, "k", "s", 1) for r in rows], DOCS)


def empty_documents(spark):
    return spark.createDataFrame([], DOCS)
