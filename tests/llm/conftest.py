import re
import zlib

import pytest

WORD = re.compile(r"[^ \t-\r]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, w string, h string, label string, seed string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, columns with clashing names."""
    base = "the quick brown fox jumps over the lazy dog and runs to the river with all of its friends by night " * 2
    texts = [None, "", " \t\n ", "one", "one", base, base, base.upper(), base + "extra", "é ß ñ 世界 😀 ü",
             "a\tb\r\nc  d", "word " * 3000 + "end", "x" * 5000, base.replace("fox", "cat")]
    rows = [(i, t, None, "s", len(t or ""), "w", "h", "l", None) for i, t in enumerate(texts)]
    rows += [rows[5], (None, base, "en", None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def words():
    return lambda t: WORD.findall((t or "").translate(LOW))


@pytest.fixture(scope="session")
def crc():
    return lambda t: zlib.crc32(t.encode())
