"""Ranked lexical search: range-maximum sparse tables per posting list, best-first document intervals.

One pass reads every document's terms and keeps the counts of those that the items ask for. Documents lie in
blocks; in a block each term's posting list carries the impact of the term on each document and a sparse table that
tells the largest impact of any range. For an item the whole block is the first interval. The sum of the terms'
range maxima bounds every score inside an interval; the interval of the largest bound is taken next and split at
the document where one term has its maximum: that document is scored exactly, and what lies left and right
of it goes back with bounds of its own. Intervals of few documents are scored as a whole. Once the best
bound is below the k-th score nothing better is left. The blocks' k best are merged per item.

All scores are 64-bit integers; statistics (documents, terms, document frequencies) cover all documents. Items are
read in batches of a bounded number of bytes, as their terms are sent to the tasks.

Defined cases: a null text holds no term; a document or an item without terms takes no part; items that share an id
count as one, with the smallest of their texts; a null item id is an id like any other; documents that share an id are
documents of their own; a null document id ranks last among equal scores; empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlab.llm.common import documents, quoted, text_of, written

BLOCK_ROWS = 4096           # documents of a block
LEAF = 256                  # documents of an interval that is scored as a whole
BATCH_BYTES = 16 << 20      # text of the items of a batch
WHOLE = float(1 << 53)
#: A-Z to a-z; 0-9, a-z and all bytes outside ASCII as they are; the rest to spaces.
FOLD = bytes(i if i >= 128 or chr(i).isalnum() else 32 for i in range(256)).lower()


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def counted(vocabulary: dict[bytes, int]):
    """n (all terms), ids and tfs (of the terms asked for) per document."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.get
        for batch in batches:
            sizes, ids, tfs = [], [], []
            for text in batch.column(1):
                terms = terms_of(text.as_py())
                found = Counter(map(number, terms))
                found.pop(None, None)
                sizes.append(len(terms))
                ids.append(list(found))
                tfs.append(list(found.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))],
                names=["doc_id", "n", "ids", "tfs"])
    return read


class Postings:
    """The posting lists of a block, one after the other, with a sparse table of the places of range maxima."""

    def __init__(self, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_docs: int, n_terms: int):
        order = np.lexsort((docs, terms))
        self.docs, self.impacts, self.n_docs = docs[order], impacts[order], n_docs
        self.keys = terms[order].astype(np.int64) * n_docs + self.docs
        self.starts = np.searchsorted(self.keys, np.arange(n_terms + 1, dtype=np.int64) * n_docs)
        longest = int(np.diff(self.starts).max(initial=1))
        self.log = np.zeros(longest + 1, np.int64)
        for i in range(2, longest + 1):
            self.log[i] = self.log[i >> 1] + 1
        size, level = len(docs), np.arange(len(docs), dtype=np.int32)
        levels = [level]
        for j in range(int(self.log[longest])):
            nearer, farther = level, np.r_[level[1 << j:], level[len(level) - min(1 << j, size):]][:size]
            level = np.where(self.impacts[nearer] >= self.impacts[farther], nearer, farther)
            levels.append(level)
        self.table = np.array(levels)

    def maxima(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The place of the largest impact of each range, none of them empty."""
        j = self.log[high - low]
        a, b = self.table[j, low], self.table[j, high - (1 << j)]
        return np.where(self.impacts[a] >= self.impacts[b], a, b)

    def search(self, terms: np.ndarray, k: int, leaf: int = LEAF) -> list[tuple[int, int]]:
        """(score, document) of the k best documents with a score above 0, best first, ties to the smaller document."""
        best: list[tuple[int, int]] = []        # heap of (score, -document)
        waiting: list[tuple] = []
        turn = 0

        def offer(score: int, doc: int) -> None:
            if score > 0:
                if len(best) < k:
                    heapq.heappush(best, (score, -doc))
                elif (score, -doc) > best[0]:
                    heapq.heapreplace(best, (score, -doc))

        def wait(first: int, end: int, terms: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
            nonlocal turn
            some = low < high
            if first < end and some.any():
                terms, low, high = terms[some], low[some], high[some]
                tops = self.maxima(low, high)
                bound = int(self.impacts[tops].sum())
                if bound > 0 and (len(best) < k or bound >= best[0][0]):
                    turn += 1
                    heapq.heappush(waiting, (-bound, turn, first, end, terms, low, high, tops))

        wait(0, self.n_docs, terms, self.starts[terms], self.starts[terms + 1])
        while waiting:
            bound, _, first, end, terms, low, high, tops = heapq.heappop(waiting)
            if len(best) == k and -bound < best[0][0]:
                break
            if end - first <= leaf:
                sizes = high - low
                places = np.repeat(low - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
                local = self.docs[places] - first
                if -bound < WHOLE:
                    scores = np.bincount(local, self.impacts[places], end - first).astype(np.int64)
                else:
                    scores = np.zeros(end - first, np.int64)
                    np.add.at(scores, local, self.impacts[places])
                if len(best) == k:
                    chosen = np.flatnonzero(scores >= best[0][0])
                elif len(scores) > k:
                    chosen = np.flatnonzero(scores >= max(1, np.partition(scores, len(scores) - k)[len(scores) - k]))
                else:
                    chosen = np.flatnonzero(scores)
                for i in chosen.tolist():
                    offer(int(scores[i]), first + i)
                continue
            cut = int(self.docs[tops[np.argmax(self.impacts[tops])]])
            at = np.searchsorted(self.keys, (self.keys[low] - self.docs[low]) + cut)
            held = (at < high) & (self.docs[np.minimum(at, len(self.docs) - 1)] == cut)
            offer(int(self.impacts[at[held]].sum()), cut)
            wait(first, cut, terms, low, at)
            wait(cut + 1, end, terms, at + held, high)
        return [(score, -doc) for score, doc in sorted(best, reverse=True)]


def weight(documents_: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents_ + 2) / (2 * holding + 1)))


def searched(items: list[tuple[int | None, list[int]]], weights: list[int], n_docs: int, n_terms: int, k: int, leaf: int):
    """item_id, doc_id, score: the k best documents of a block for each item."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("key", "ascending")]).combine_chunks()
        n, ids, tfs = table["n"].to_numpy(), table["ids"].combine_chunks(), table["tfs"].combine_chunks()
        ids, tfs = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (ids, tfs))
        docs = np.repeat(np.arange(len(n)), np.diff(ids.offsets.to_numpy()))
        terms, tf = ids.flatten().to_numpy(), tfs.flatten().to_numpy()
        m = 50 + (50 * n * n_docs) // n_terms
        impacts = np.array(weights, np.int64)[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[docs]))
        lists = Postings(terms, docs, impacts, len(n), len(weights))
        named, out = table["doc_id"], ([], [], [])
        for item, wanted in items:
            for score, doc in lists.search(np.array(wanted, np.int64), k, leaf):
                out[0].append(item), out[1].append(named[doc].as_py()), out[2].append(score)
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["item_id", "doc_id", "score"])
    return run


def search_batch(docs: DataFrame, items: list[tuple[int | None, bytes]], k: int, block_rows: int, leaf: int) -> DataFrame:
    """item_id, doc_id, score: the k best of every block for the items of one batch; docs: doc_id, text."""
    vocabulary: dict[bytes, int] = {}
    asked = [(i, sorted({vocabulary.setdefault(t, len(vocabulary)) for t in terms_of(text)})) for i, text in items]
    asked = [x for x in asked if x[1]]
    found = written(docs.mapInArrow(counted(vocabulary), "doc_id long, n long, ids array<int>, tfs array<long>")
                    .filter("n > 0").withColumn("key", F.monotonically_increasing_id()), "terms")
    total = found.agg(F.count("*").alias("N"), F.coalesce(F.sum("n"), F.lit(1)).alias("L")).first()
    held = {r[0]: r[1] for r in found.select(F.explode("ids").alias("t")).groupBy("t").count().collect()}     # at most one row per term asked for
    weights = [weight(total["N"], held.get(t, 0)) for t in range(len(vocabulary))]
    blocks = max(1, math.ceil(total["N"] / block_rows))
    rows = found.filter(F.size("ids") > 0).withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    return rows.groupBy("block").applyInArrow(
        searched(asked, weights, total["N"], total["L"], k, leaf), "item_id long, doc_id long, score long")


def top_documents(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", block_rows: int = BLOCK_ROWS, leaf: int = LEAF, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k highest-scoring documents with a score above 0."""
    rows = docs.select(quoted(doc_id).cast("long").alias("doc_id"), text_of(text).cast("binary").alias("text"))
    asked = written(items.groupBy(quoted(item_id).cast("long").alias("item_id")).agg(F.min(text_of(item_text).cast("binary")).alias("text")), "items")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    batches = max(1, math.ceil(size / batch_bytes))
    found = None
    for b in range(batches):
        part = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(batches)) == b)
        one = search_batch(rows, [(r.item_id, bytes(r.text)) for r in part.collect()], k, block_rows, leaf)     # bounded by batch_bytes
        found = one if found is None else found.union(one)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score"))


def op12_range_maximum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH q AS (SELECT item_id, min(coalesce(text, '')) AS text FROM benchmark GROUP BY item_id),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM q),
d AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
c AS (SELECT count(*) AS big_n, sum(len(terms)) AS big_l FROM d WHERE len(terms) > 0),
p AS (
  SELECT row, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf
  FROM (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY row, term),
w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM p, c WHERE term IN (SELECT term FROM i) GROUP BY term, big_n),
s AS (
  SELECT item_id, row, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * n * big_n) // big_l))))) AS BIGINT) AS score
  FROM i JOIN w USING (term) JOIN p USING (term), c GROUP BY item_id, row)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS r FROM s WHERE score > 0)
WHERE r <= 50"""
