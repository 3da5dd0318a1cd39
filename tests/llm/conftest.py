import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Names that the operators use for columns of their own.
CLASHING = "row copies target source_size _copy _size _gone _block _target _source_size _id _text _cell _rank _n_bytes id h node part raw nth hash class shard slot keep found text_crc32 n_words kept limit c p".split()


def make(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, clashing names."""
    words = [f"w{i % 701}x{i % 13}" for i in range(30_000)]
    base = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix potions beneath an old stone bridge at night and nobody sees them leave before dawn comes over the hills again. " * 2
    varied = " ".join(f"term{i}" for i in range(120))
    near = varied.replace("term60 ", "changed ")
    rows = [
        (1, base + varied, "en", "a", 10),
        (2, base + varied, "en", "a", 10),
        (3, near, "en", "b", None),
        (4, varied, None, "b", 5),
        (5, None, "en", "a", None),
        (6, "", "en", None, 0),
        (7, " \n\t ", "en", "a", 4),
        (8, "three short words", "en", "a", 1),
        (8, "three short words", "en", "a", 1),
        (9, " ".join(words), "en", "c", 1),
        (10, "ümlaut ÄÖ é " * 30 + "\n" + "line one\nline one\nline one", "de", "c", 1),
        (None, base + varied, "en", "a", 1),
        (11, "Licensed under the Apache License, Version 2.0. Released under the MIT License.", "en", "d", 1),
        (12, "a b c d e f g\n" * 40, "en", "d", 1),
        (13, "### *** $$$ ### " * 40 + varied, "en", "d", 1),
    ]
    rows += [(4, varied + " and more " * 20, "fr", "b", 5), (14, near, None, None, None), (14, near, None, None, None)]
    extra = [(*r, float(k), "key", k, *[f"{name}{k % 3}" for name in CLASHING]) for k, r in enumerate(rows)]
    return make(spark, extra, SCHEMA + ", size double, `key` string, _row int, " + ", ".join(f"`{name}` string" for name in CLASHING))


@pytest.fixture(scope="session")
def no_docs(spark):
    return make(spark, [])
