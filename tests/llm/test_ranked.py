"""Ranked search against plain scoring, in any blocks and batches, ties, odd rows; sparse tables against plain maxima."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from barlab.llm import ranked
from checks.compare import connect, difference

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain(docs, items, k):
    """Sorted (item, rank, score) and the set of (item, doc, score) that may be listed."""
    read = [(i, Counter(terms(t))) for i, t in docs]
    read = [(i, c, sum(c.values())) for i, c in read if c]
    n, total = len(read), sum(x[2] for x in read)
    df = Counter(t for _, c, _ in read for t in c)
    merged = {}
    for i, t in items:
        merged[i] = min(merged.get(i, t or ""), t or "", key=str.encode)
    out = []
    for i, text in merged.items():
        scores = []
        for d, c, size in read:
            m = 100 - 50 + (50 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_its_sql(spark):
    assert difference("op12", spark, SF, ranked.op12_range_maximum, ranked.SQL, connect(SF)) is None


@pytest.mark.parametrize(("block", "leaf", "batch"), [(7, 1, 1 << 20), (50, 3, 40), (4096, 256, 1 << 20), (4096, 2, 300)])
def test_any_blocks_leaves_and_batches(spark, block, leaf, batch):
    rng = random.Random(block + leaf)
    word = lambda: rng.choice(["a", "B", "b", "çé", "x1", "zz", "ONE", "one", "日本", "r" * rng.randrange(1, 4)])
    text = lambda n: " ,".join(word() for _ in range(rng.randrange(n)))
    docs = [(rng.randrange(300), text(rng.choice([3, 30, 90]))) for _ in range(200)]
    docs += [(500 + i, "one zz one") for i in range(70)]                # more ties than places
    items = [(i % 11, text(9)) for i in range(14)] + [(77, None), (78, "absent"), (79, "zz")]
    got = ranked.top_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"),
                               block_rows=block, leaf=leaf, batch_bytes=batch)
    assert rows_of(got) == plain(docs, items, 50)


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "MIT license fox", 0.1), (None, "word", 0.2), (2, "id email no", 0.3), (2, "id email no", 0.3), (3, "!?", 0.4)],
                                  "item_id long, text string, score double")
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    want = plain(docs, [(r.item_id, r.text) for r in items.collect()], 50)
    assert rows_of(ranked.top_documents(odd, items)) == want and want
    assert ranked.top_documents(none, items).count() == 0 and ranked.top_documents(odd, items.limit(0)).count() == 0


def test_sparse_tables():
    rng = np.random.default_rng(4)
    terms_ = np.repeat(np.arange(9), rng.integers(0, 60, 9))
    docs = np.concatenate([np.sort(rng.choice(64, n, replace=False)) for n in np.bincount(terms_, minlength=9)])
    lists = ranked.Postings(terms_, docs, rng.integers(0, 9, len(docs)), 64, 9)
    for t in range(9):
        for low in range(lists.starts[t], lists.starts[t + 1]):
            for high in range(low + 1, lists.starts[t + 1] + 1):
                at = lists.maxima(np.array([low]), np.array([high]))[0]
                assert low <= at < high and lists.impacts[at] == lists.impacts[low:high].max()


def test_intervals_below_the_bound_are_left_out():
    n = 20000
    lists = ranked.Postings(np.zeros(n, np.int64), np.arange(n), np.r_[np.full(10, 1000), np.ones(n - 10)].astype(np.int64), n, 1)
    calls = []
    plain_maxima = lists.maxima
    lists.maxima = lambda low, high: calls.append(1) or plain_maxima(low, high)
    assert lists.search(np.array([0]), 10, leaf=8) == [(1000, i) for i in range(10)] and len(calls) < 60
