from __future__ import annotations

import pytest

# Every name that operators use for columns of their own.
CLASHING = ["id", "row", "n", "key", "class", "label", "digest", "length", "size", "text_crc32", "head", "token", "domain", "host", "best"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)

LONG = " ".join(f"word{i % 977}x{i % 31} and{'.' if i % 9 == 0 else ''}" + ("\n" if i % 40 == 0 else "") for i in range(30_000))
PLAIN = "\n".join(f"This is the number {i} of some plain lines. It ends here." for i in range(12))
ODD_ROWS = [
    (1, PLAIN, "en", "a", 1), (2, PLAIN, "en", "a", 1), (3, PLAIN + " \t", None, None, None),
    (4, "", "en", "a", 0), (5, None, None, "b", None), (6, " \n\t\x0b\x0c\r", "de", "b", 6),
    (7, LONG, "en", "a", len(LONG)), (8, LONG + "\nOne more line here.", "en", "a", 0),
    (9, "one two three", "fr", "a", 1), (10, "One  Two\nThree", "fr", "a", 1), (11, "x", "fr", "a", 1),
    (None, "a text whose id is not known at all", "en", "a", 1), (None, PLAIN, "en", None, 1),
    (12, "twice the same row", "en", "a", 1), (12, "twice the same row", "en", "a", 1),
    (13, "Grüße, été und <|endoftext|> 中文 🙂   fin", "de", "b", 1),
    (14, "\n\n\n", "en", "a", 3), (15, "no newline at the end\nof this\none", "en", "a", 1),
]


def table(spark, rows):
    return spark.createDataFrame([(*r, *[None] * len(CLASHING)) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, copies, repeated rows and columns with clashing names."""
    return table(spark, ODD_ROWS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return table(spark, [])


@pytest.fixture(scope="session")
def sf(spark, tmp_path_factory):
    """A small share of the generated documents and their labels, as a table folder."""
    folder = str(tmp_path_factory.mktemp("sf"))
    for t in ("documents", "labels", "pages"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    return folder
