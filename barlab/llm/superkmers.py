"""Substring dedup by super-k-mers: words covered by a window of an earlier document go.

A window is 50 consecutive words. Its minimiser is the smallest hash of its 8-word runs, and consecutive
windows of one document with the same minimiser form a super-k-mer, packed as one string of their words and
sent to the bucket of that minimiser. Equal windows have equal minimisers, so they meet in one bucket.

1. Every document gives its minimisers. A bucket that one document alone reaches holds no repeat of another
   document, so only shared buckets go on; they are found by a partial minimum and maximum of the ids.
2. Documents that reach shared buckets pack their super-k-mers. Equal strings are merged to the smallest and
   the largest id before anything is gathered, so a group of copies is one string.
3. Groups of buckets sort the windows of their strings; the smallest id of each run of equal windows is where
   it was first seen. A crowded bucket (a passage in many different surroundings) is not sorted by one
   task: its windows are named by digests and counted by a partially combined aggregate.
4. The first ids return to the documents over the strings' digests, and each document drops the words covered.

In the buckets the words themselves are compared. A string, and a window of a crowded bucket, is named by a 128-bit
BLAKE2 digest of its words, so that no text travels back. Nothing is dropped: a run of more than PIECE
windows is cut into several strings.

Defined cases: a null text has no words; a document of fewer than 50 words keeps all; a window that starts
twice in the same document only is kept; rows that share an id are documents of their own that never remove
each other's words; a row with a null id neither removes nor loses words; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from barlab.llm.common import documents, quoted, text_of, written

WINDOW = 50
RUN = 8                 # words of a minimiser
SEED = 13
PIECE = 256             # windows of a packed string at most
CROWD = 1 << 17         # windows of distinct strings that one bucket sorts
GROUP_ROWS = 2048       # strings of a group of buckets


def words_of(text: bytes) -> list[bytes]:
    return text.split()             # bytes: ASCII white space alone


def smallest_of(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[:len(values) - (width - span)], values[width - span:]) if width > span else values


def minimisers(words: list[bytes], window: int, run: int) -> np.ndarray:
    """The minimiser of each window, as signed 64-bit integers."""
    if len(words) < window:
        return np.zeros(0, np.int64)
    each = np.fromiter(map(xxh64_intdigest, words, repeat(SEED)), np.uint64, len(words))
    n = len(words) - run + 1
    mixed = np.zeros(n, np.uint64)
    for i in range(run):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + each[i:i + n]
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return smallest_of(mixed, window - run + 1).view(np.int64)


def super_kmers(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(minimiser, first window, windows) of each run of equal minimisers, cut at PIECE."""
    if not len(values):
        return
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]).tolist()
    for at, stop in zip(starts, [*starts[1:], len(values)]):
        for first in range(at, stop, PIECE):
            yield int(values[at]), first, min(PIECE, stop - first)


def windows_of(packed: bytes, window: int) -> list[bytes]:
    """The windows of a packed string, in order."""
    ends = list(accumulate(map((1).__add__, map(len, packed.split(b" "))), initial=0))
    return [packed[a:b - 1] for a, b in zip(ends, ends[window:])]


def name(words: bytes) -> bytes:
    return hashlib.blake2b(words, digest_size=16).digest()


def digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def surveyed(window: int, run: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, buckets = [], [], []
            for one, text in zip(batch.column(0).is_valid().to_pylist(), batch.column(2)):
                words = words_of(text.as_py())
                counts.append(len(words))
                digests.append(digest(words))
                buckets.append(np.unique(minimisers(words, window, run)) if one else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests), pa.array(buckets, pa.list_(pa.int64()))],
                names=["doc_id", "mark", "n_words", "whole", "buckets"])
    return read


def packed_rows(window: int, run: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                wanted = set(batch.column(3)[k].values.to_pylist())
                words = words_of(batch.column(2)[k].as_py())
                found = [x for x in super_kmers(minimisers(words, window, run)) if x[0] in wanted]
                packed = [b" ".join(words[at:at + m + window - 1]) for _, at, m in found]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([batch.column(c)[k].as_py()] * len(found), pa.int64()) for c in (0, 1)), pa.array([x[1] for x in found], pa.int64()),
                     pa.array([x[0] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64()),
                     pa.array(map(name, packed), pa.binary()), pa.array(packed, pa.binary())],
                    names=["doc_id", "mark", "first", "bucket", "windows", "code", "packed"])
    return read


def sorted_group(window: int):
    """code, seen: where each window of a string was first seen, for strings with anything to remove."""
    def run(table: pa.Table) -> pa.Table:
        low, high = (table[c].to_numpy() for c in ("low", "high"))
        lists = [windows_of(x.as_py(), window) for x in table["packed"]]
        sizes = [len(x) for x in lists]
        every = [w for x in lists for w in x]
        owner = np.repeat(np.arange(len(lists)), sizes)
        order = np.array(sorted(range(len(every)), key=every.__getitem__), np.int64)
        seen = np.zeros(len(every), np.int64)
        if len(every):
            fresh = np.fromiter((i == 0 or every[order[i]] != every[order[i - 1]] for i in range(len(order))), bool, len(order))
            starts = np.flatnonzero(fresh)
            least = np.minimum.reduceat(low[owner[order]], starts)
            seen[order] = np.repeat(least, np.diff(np.r_[starts, len(order)]))
        parts = np.split(seen, np.cumsum(sizes)[:-1]) if sizes else []
        places = [i for i, x in enumerate(parts) if (x < high[i]).any()]
        return pa.table({"code": table["code"].take(pa.array(places, pa.int64())).cast(pa.binary()),
                         "seen": pa.array([parts[i] for i in places], pa.list_(pa.int64()))})
    return run


def split_windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                parts = windows_of(batch.column(1)[k].as_py(), window)
                code, low, high = (batch.column(c)[k].as_py() for c in (0, 2, 3))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([code] * len(parts), pa.binary()), pa.array([low] * len(parts), pa.int64()), pa.array([high] * len(parts), pa.int64()),
                     pa.array(range(len(parts)), pa.int32()), pa.array(map(name, parts), pa.binary())],
                    names=["code", "low", "high", "place", "name"])
    return run


def first_seen(strings: DataFrame, window: int, crowd: int) -> DataFrame:
    """code, seen (array of the first id per window) of the strings with anything to remove; strings: code, bucket, windows, packed, low, high."""
    crowded = written(strings.groupBy("bucket").agg(F.sum("windows").alias("n")).filter(F.col("n") > crowd).select("bucket"), "crowded")     # its size decides the joins
    rows = strings.count()
    groups = max(int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / GROUP_ROWS))
    calm = strings.join(crowded, "bucket", "left_anti").select(F.pmod(F.xxhash64("bucket"), F.lit(groups)).alias("group"), "code", "packed", "low", "high")
    usual = calm.groupBy("group").applyInArrow(sorted_group(window), "code binary, seen array<long>")
    single = strings.join(crowded, "bucket", "left_semi").select("code", "packed", "low", "high").mapInArrow(
        split_windows(window), "code binary, low long, high long, place int, name binary")
    least = single.groupBy("name").agg(F.min("low").alias("first"), F.max("high").alias("last")).filter("first < last").select("name", "first")
    split = (single.join(least, "name").filter(F.col("first") < F.col("high"))
             .select("code", F.struct("place", F.col("first").alias("seen")).alias("x")))
    whole = split.groupBy("code").agg(F.map_from_entries(F.collect_list("x")).alias("m"))
    spread = whole.select("code", F.transform(
        F.sequence(F.lit(0), F.array_max(F.map_keys("m"))), lambda i: F.try_element_at("m", i)).alias("seen"))
    return usual.union(spread)


def covered(window: int) -> Column:
    """(first word, end) of the runs of words that windows first seen in a smaller id cover, from first, seen, doc_id."""
    hits = F.filter(F.transform("seen", lambda x, i: F.when(x < F.col("doc_id"), F.col("first") + i)), lambda x: x.isNotNull())
    merged = F.aggregate(hits, F.array().cast("array<struct<a:bigint,b:bigint>>"), lambda acc, at: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["b"] >= at),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), (at + window).alias("b")))))
        .otherwise(F.concat(acc, F.array(F.struct(at.alias("a"), (at + window).alias("b"))))))
    return merged


def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, digests = [], []
        for text, runs in zip(batch.column(2), batch.column(3)):
            words = words_of(text.as_py())
            keep = np.ones(len(words), bool)
            for x in runs.as_py():
                keep[x["a"]:x["b"]] = False
            kept = [w for w, k in zip(words, keep.tolist()) if k]
            removed.append(len(words) - len(kept))
            digests.append(digest(kept))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(digests)],
                                         names=["doc_id", "mark", "gone", "rest"])


def removed_runs(reached: DataFrame, window: int, run: int, crowd: int) -> DataFrame:
    """doc_id, mark, runs: the runs of words (a, b) that go, for documents that lose any; reached: doc_id, mark, text, wanted."""
    pieces = written(reached.select("doc_id", "mark", "text", "wanted").mapInArrow(
        packed_rows(window, run), "doc_id long, mark long, first long, bucket long, windows long, code binary, packed binary"), "pieces")
    strings = written(pieces.groupBy("bucket", "windows", "code", "packed").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")), "strings")
    return (pieces.select("doc_id", "mark", "first", "code").join(first_seen(strings, window, crowd), "code")
            .select("doc_id", "mark", F.explode(covered(window)).alias("x"))
            .groupBy("doc_id", "mark").agg(F.collect_set("x").alias("runs")))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, run: int = RUN, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) and runs, the runs of words removed."""
    run = min(run, window)
    rows = docs.select(quoted(doc_id).cast("long").alias("doc_id"), F.xxhash64(text_of(text)).alias("mark"), text_of(text).cast("binary").alias("text"))
    found = written(rows.mapInArrow(surveyed(window, run), "doc_id long, mark long, n_words long, whole string, buckets array<long>"), "minimisers")
    each = found.select("doc_id", F.explode("buckets").alias("bucket"))
    shared = (each.groupBy("bucket").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("bucket"))
    wanted = each.join(shared, "bucket").groupBy("doc_id").agg(F.collect_set("bucket").alias("wanted"))
    reached = written(rows.join(wanted, "doc_id"), "reached")
    runs = written(removed_runs(reached, window, run, crowd), "runs")
    cut = (reached.drop("wanted").join(runs, ["doc_id", "mark"]).select("doc_id", "mark", "text", "runs").mapInArrow(
        applied, "doc_id long, mark long, gone long, rest string").groupBy("doc_id", "mark").agg(F.max("gone").alias("gone"), F.max("rest").alias("rest")))
    return (found.drop("buckets").join(cut, ["doc_id", "mark"], "left").join(runs, ["doc_id", "mark"], "left")
            .select("doc_id", "n_words", F.coalesce("gone", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("rest", "whole").alias("kept_sha256"), "runs"))


def op13_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir)).drop("runs")


SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (
  SELECT doc_id, row, i, array_to_string(words[i:i + 49], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(words) - 48)) AS i FROM d WHERE len(words) >= 50 AND doc_id IS NOT NULL)),
f AS (SELECT win, min(doc_id) AS first FROM w GROUP BY win),
hit AS (SELECT w.row, w.i FROM w JOIN f USING (win) WHERE f.first < w.doc_id),
gone AS (SELECT DISTINCT row, unnest(range(i, i + 50)) AS pos FROM hit),
l AS (SELECT row, list(pos) AS ats FROM gone GROUP BY row),
k AS (
  SELECT d.doc_id, d.words, coalesce(l.ats, CAST([] AS BIGINT[])) AS ats,
    list_filter(d.words, lambda x, i: NOT list_contains(l.ats, i)) AS kept, l.row IS NULL AS whole
  FROM d LEFT JOIN l USING (row))
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(ats) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN whole THEN words ELSE kept END, ' ')) AS kept_sha256
FROM k"""
