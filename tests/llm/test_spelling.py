"""Spelling variants against all pairs of words, tries against plain prefixes, chains of forms, odd rows."""

import random
import re
from collections import Counter
from zlib import crc32

import pytest

from barlab.llm import spelling

SF = "/root/testdata/sf0.001"


def near(a, b):
    """Exactly one inserted, deleted or replaced letter."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(docs, typo=199, letters=6, times=5, ratio=5):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % typo == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= letters and n >= times}
    out, forms, shapes = {}, {}, {}
    for w in words:                         # words with a letter left out or not: only these can be near
        for i in range(len(w)):
            shapes.setdefault(w[:i] + w[i + 1:], set()).add(w)
        shapes.setdefault(w, set()).add(w)
    for w in words:
        around = {w} | {w[:i] + w[i + 1:] for i in range(len(w))}
        found = {v for s in around for v in shapes.get(s, ()) if near(w, v)}
        best = min(found, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if found and words[best] >= ratio * words[w] else None
        out[w] = len(found)
    rows = []
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        rows.append((w, forms[w], root, n, out[w], words.get(forms[w])))
    return sorted(rows)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_query_on_a_table(spark, real):
    got = rows_of(spelling.op11_trie_pairs(spark, SF))
    assert got == plain([(r.doc_id, r.text) for r in real.collect()])
    assert any(r[1] for r in got)


@pytest.mark.parametrize(("letters", "parts"), [(1, 1), (2, 5), (4, 13)])
def test_dense_words_against_all_pairs(spark, letters, parts):
    rng = random.Random(letters)
    word = lambda: "".join(rng.choice("aabÀÿ÷") for _ in range(rng.randrange(letters, letters + 4)))
    docs = [(rng.choice([None, i]), " ".join([word() for _ in range(rng.randrange(60))] + ["aab" * (i % 3), "AAB"])) for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        assert rows_of(spelling.variants(df, typo=7, letters=letters, times=2, ratio=2)) == plain(docs, 7, letters, 2, 2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_chains_are_followed_to_their_root(spark):
    words = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb", "aabbbb", "abbbbb"]
    docs = [(10 ** 6 + i, " ".join([w] * 3 ** i)) for i, w in enumerate(words)]
    got = rows_of(spelling.variants(spark.createDataFrame(docs, "doc_id long, text string"), typo=10 ** 9 + 7, times=1, ratio=3))
    assert [r[2] for r in got] == ["abbbbb"] * 6 and [r[1] for r in got] == [*words[1:], None]


def test_nodes_of_tries_are_prefixes(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("abÿ") for _ in range(rng.randrange(1, 9))) for _ in range(400)} | {""}
    for parts in (1, 3, 40):
        kept = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        rows = spelling.trie(spark.createDataFrame([(w,) for w in words], "word string").repartition(4)).collect()
        spark.conf.set("spark.sql.shuffle.partitions", kept)
        nodes, prefixes = {}, {}
        for r in rows:
            for i, node in enumerate(r.nodes):
                assert nodes.setdefault(node, r.word[:i]) == r.word[:i] and prefixes.setdefault(r.word[:i], node) == node
        assert {r.word for r in rows} == words and all(len(r.nodes) == len(r.word) + 1 for r in rows)


def test_odd_rows(spark, odd, none):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert rows_of(spelling.variants(odd, letters=3, times=1)) == plain(docs, letters=3, times=1)
    assert rows_of(spelling.variants(none)) == []
    big = "x" * 20000
    docs = [(1, f"{big} {big}y {big}"), (2, big.upper())]
    assert rows_of(spelling.variants(spark.createDataFrame(docs, "doc_id long, text string"), times=1)) == plain(docs, times=1)


def test_many_partitions_that_share_long_prefixes(spark):
    keys = {"spark.sql.shuffle.partitions": "9", "spark.sql.adaptive.coalescePartitions.enabled": "false"}      # else small tables are one partition
    rng = random.Random(5)
    docs = [(i, " ".join("stem" + "".join(rng.choice("abÿ") for _ in range(rng.randrange(2, 7))) for _ in range(40))) for i in range(60)]
    kept = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        assert spelling.trie(spark.createDataFrame([(x,) for x in {w for _, t in docs for w in t.split()}], "word string")).rdd.getNumPartitions() > 3
        assert rows_of(spelling.variants(spark.createDataFrame(docs, "doc_id long, text string"), typo=7, times=1, ratio=2)) == plain(docs, 7, 6, 1, 2)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
