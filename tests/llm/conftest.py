import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SF = "/root/testdata/sf0.001"
LONG = "word " * 30000
TEXTS = [
    (1, "Released under the MIT License.\nThe quick brown fox jumps over the lazy dog again and again.", "en", "src0"),
    (2, "Released under the MIT License.\nThe quick brown fox jumps over the lazy dog again and again.", "en", "src0"),
    (3, None, None, None), (4, "", "en", "src1"), (5, "  \n\t ", "en", ""), (6, LONG, "en", "src0"),
    (7, "mail a@b.co or 1.2.3.4, card 4111 1111 1111 1111, call +1 (555) 123-4567 now", "en", "src2"),
    (8, "Ünïcödé ñandú Σίσυφος ΟΔΟΣ 👩‍👩‍👧 <|endoftext|> x", "de", "src3"),
    (9, "cc by-nc and under the mit, license; Apache License (Version 2.0)", "en", "src1"),
    (None, "no id here", "fr", "src4"), (7, "mail a@b.co", "en", "src2"), (4, "", "en", "src1"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, copies, repeated ids, and extra columns named like the operators' own."""
    rows = [(*r, len(r[1]) if r[1] is not None else None, "x", 1, [1], "y", 0.5) for r in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, fingerprint string, copy int, "
                                       "ids array<int>, `fp` string, score double")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def real_texts(real):
    return {r.doc_id: r.text or "" for r in real.collect()}
