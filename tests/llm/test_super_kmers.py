"""Super-k-mer dedup against a plain dictionary of windows, small and crowded buckets, odd rows."""

import hashlib
import random

import numpy as np
import pytest

from barlab.llm import superkmers
from checks.compare import connect, difference

SF = "/root/testdata/sf0.001"


def plain(rows, window):
    """(doc_id, n_words, n_removed, sha) per row, from the smallest id of every window."""
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for at in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[at:at + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = {at + j for at in range(len(w) - window + 1) if i is not None and first[tuple(w[at:at + window])] < i for j in range(window)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r)[:4] for r in df.collect()), key=str)


def test_query_equals_its_sql(spark):
    assert difference("op13", spark, SF, superkmers.op13_super_kmers, superkmers.SQL, connect(SF)) is None


@pytest.mark.parametrize(("window", "run", "crowd"), [(3, 2, 1000), (3, 2, 0), (5, 9, 2), (4, 1, 1)])
def test_small_windows_against_all(spark, window, run, crowd):
    rng = random.Random(window * 10 + crowd)
    rows = [(rng.randrange(40), " ".join(rng.choice("ab ç d".split()) for _ in range(rng.randrange(14)))) for _ in range(60)]
    rows += [(100 + i, "x y z u v w " * (i % 3) + "tail " * i) for i in range(8)] + rows[:5]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(superkmers.dedup(df, window=window, run=run, crowd=crowd)) == plain(rows, window)


def test_a_passage_in_many_surroundings(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = " ".join(word() for _ in range(70))
    rows = [(i, " ".join(word() for _ in range(60)) + " " + passage + "\n" + " ".join(word() for _ in range(60))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for crowd in (10, 1000):
        got = superkmers.dedup(df, crowd=crowd)
        assert rows_of(got) == plain(rows, 50)
        assert {r.doc_id: r.n_removed for r in got.collect()} == {i: 70 if i else 0 for i in range(80)}


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert rows_of(superkmers.dedup(odd)) == plain(rows, 50)
    big = spark.createDataFrame([(1, "word " * 30000, 0), (2, "word " * 50, 0), (3, "a b " * 40000, 1), (None, "word " * 99, 1)],
                                "doc_id long, text string, bucket int")
    assert rows_of(superkmers.dedup(big)) == plain([(r.doc_id, r.text) for r in big.collect()], 50)
    assert superkmers.dedup(none).count() == 0 and superkmers.dedup(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).count() == 2


def test_minima_and_runs():
    x = np.random.default_rng(1).integers(0, 50, 200).astype(np.uint64)
    for width in (1, 2, 3, 7, 43):
        assert superkmers.smallest_of(x, width).tolist() == [int(x[i:i + width].min()) for i in range(len(x) - width + 1)]
    runs = list(superkmers.super_kmers(np.array([4] * 600 + [5, 5, 4])))
    assert [m for _, _, m in runs] == [256, 256, 88, 2, 1] and [a for _, a, _ in runs] == [0, 256, 512, 600, 602]
