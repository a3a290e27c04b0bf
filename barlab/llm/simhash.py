"""SimHash near-duplicates by deletion-variant signatures.

A document's 64-bit fingerprint is the bitwise majority of the XXH64 values of its 4-word shingles.
Fingerprints link at ``distance`` differing bits or fewer. With 4 bits and three segments one
segment differs in at most one bit, so each distinct fingerprint is indexed under every segment
with every single bit left out (64 keys), and an equality join on the keys finds all candidates,
which are then verified.

Most buckets hold two fingerprints that met by chance: the smallest and the largest of a bucket of two
are the pair, so it is verified in the first aggregation and goes before anything is joined.

No group is expanded into its pairs. Equal fingerprints are one node. First those that share a whole
segment are compared with the smallest and the largest of their number only; that links the bulk of a group of near
copies, and components are found over these links. Buckets whose members all share a component need no further link.
The others are sorted by the bits outside their segment, and each member is compared with the few before it; in a
crowded bucket that links nearly all that has many links, and components are joined over these, too. What is then still
apart is compared in full: the members outside the bucket's most common component, with all others. So the components are
exact, and a pair is a row of that join once, under the first key that it shares.

Defined cases: a null text is empty; without words the fingerprint is zero, which links like any
other; fewer than four words are one shingle; rows with equal ids stay rows of their own; a null
id gets a fingerprint and a component too, but never names one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from barlab.llm.common import documents, forget, quoted, small_batches, stored, text_of
from barlab.llm.components import components

WORDS = 4
SEED = 42
DISTANCE = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))        # first bit, length: one more segment than half the distance
BEFORE = 8                                      # members that one is compared with before the full comparison
PIECE = 1 << 18                                 # shingles counted at a time
SPREAD = 1 << 14                                # fingerprints that one task writes under all their keys
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str) -> int:
    """Majority of the shingles' hashes, as a signed 64-bit integer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()      # bytes: A-Z and ASCII white space alone
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate(map((1).__add__, map(len, words)), initial=-1))      # before each word's first byte: its separator
    width = min(WORDS, len(words))
    shingles = len(words) - width + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, shingles, PIECE):
        stop = min(at + PIECE, shingles)
        slices = map(slice, map((1).__add__, ends[at:stop]), ends[at + width:stop + width])
        hashes = np.fromiter(map(xxh64_intdigest, map(line.__getitem__, slices), repeat(SEED)), np.uint64, stop - at)
        octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
        if len(octets) <= 1024:
            counts += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
        else:
            counts += np.concatenate([np.bincount(octets[:, i], minlength=256) @ BITS for i in range(8)])
    value = int.from_bytes(np.packbits(counts * 2 > shingles, bitorder="little").tobytes(), "little")
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (long): one row per row."""
    small_batches(docs.sparkSession)
    rows = docs.select(quoted(doc_id).alias("doc_id"), text_of(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            values = [fingerprint(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], names=["doc_id", "fp"])

    return rows.mapInArrow(run, rows.select("doc_id").schema.add("fp", "long"))


def differing(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def segment(first: int, length: int) -> Column:
    return F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << length) - 1).cast("long"))


def whole_segments() -> list[Column]:
    """A key for each segment as it is."""
    return [segment(*s).bitwiseOR(F.lit(i << 22).cast("long")) for i, s in enumerate(SEGMENTS)]


def deletion_variants() -> list[Column]:
    """A key for each segment with each one of its bits left out; the key also tells which."""
    keys: list[Column] = []
    for first, length in SEGMENTS:
        for bit in range(length):
            rest = segment(first, length).bitwiseAND(F.lit(((1 << length) - 1) ^ (1 << bit)).cast("long"))
            keys.append(rest.bitwiseOR(F.lit(len(keys) << 22).cast("long")))
    return keys


def near(a: str, b: str) -> Column:
    return (F.col(a) != F.col(b)) & (differing(a, b) <= DISTANCE)


def stars(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that connect each fingerprint with the smallest and the largest that share a whole segment with it.

    The largest is left out where both it and the fingerprint are linked to the smallest, as nothing is gained then.
    A fingerprint has at most six such ends: it is linked to the first, and the first to the others, so
    that members of a group repeat the same few links between ends.
    """
    rows = nodes.select("fp", F.explode(F.array(*whole_segments())).alias("key"))
    ends = rows.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low <> high")
    joined = near("fp", "low") & (differing("low", "high") <= DISTANCE)
    targets = F.array_compact(F.array(F.when(near("fp", "low"), F.col("low")), F.when(near("fp", "high") & ~joined, F.col("high"))))
    found = (rows.hint("merge").join(ends, "key").select(F.col("fp").alias("a"), F.explode(targets).alias("b"))
             .groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("ends")))
    others = found.select(F.col("ends")[0].alias("a"), F.explode(F.slice("ends", 2, 6)).alias("b")).distinct()
    return found.select("a", F.col("ends")[0].alias("b")).union(others)


def crowded(parts: DataFrame) -> DataFrame:
    """key, fp, part: the members of all buckets that may hold a link between parts; parts: distinct fp, part.

    A fingerprint becomes 64 rows, so the few tasks that its table fits into are not enough to write and group these. Spark
    sizes an explode by its input and would broadcast these rows while the fingerprints are few; hence the merge joins here and in ``stars``.
    """
    dealt = parts.repartition(1 + parts.count() // SPREAD, "fp")
    rows = dealt.select("fp", "part", F.explode(F.array(*deletion_variants())).alias("key"))
    buckets = rows.groupBy("key").agg(
        F.min("part").alias("p"), F.max("part").alias("q"), F.min("fp").alias("low"), F.max("fp").alias("high"), F.count("*").alias("n"))
    mixed = buckets.filter((F.col("p") != F.col("q")) & ((F.col("n") > 2) | (differing("low", "high") <= DISTANCE)))
    return rows.hint("merge").join(mixed.select("key"), "key")


def neighbours(members: DataFrame) -> DataFrame:
    """Links (a, b, part_a, part_b) of each member with the nearest before it in its bucket that is of another part, of the
    last ``BEFORE`` in the order of the bits outside the segment.

    The sort deals by those bits, too, so a large bucket is spread over many tasks; what it cuts apart is left to ``bridges``.
    """
    place = F.shiftright("key", 22)
    turned, stop = F.lit(None).cast("long"), 64
    for first, length in reversed(SEGMENTS):                # the bits below the segment move to the top, those above it to the bottom
        others = F.shiftleft("fp", 64 - first) if first else F.lit(0).cast("long")
        if first + length < 64:
            others = others.bitwiseOR(F.shiftrightunsigned("fp", first + length))
        turned = F.when(place < stop, others).otherwise(turned)
        stop -= length
    ordered = members.select("key", turned.alias("turned"), "fp", "part").orderBy("key", "turned").select("key", "fp", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            new = batch.num_rows
            key, fp, part = last = [np.r_[old, c.to_numpy()] for old, c in zip(last, batch.columns)]
            to = np.full(len(key), -1)
            for d in range(BEFORE, 0, -1):                  # the nearest is written last
                fits = (key[d:] == key[:-d]) & (part[d:] != part[:-d]) & (np.bitwise_count((fp[d:] ^ fp[:-d]).view(np.uint64)) <= DISTANCE)
                at = np.flatnonzero(fits) + d
                to[at] = at - d
            at = np.flatnonzero(to >= 0)
            at = at[at >= len(key) - new]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (fp[at], fp[to[at]], part[at], part[to[at]])], names=["a", "b", "part_a", "part_b"])
            last = [x[-BEFORE:] for x in last]

    return ordered.mapInArrow(run, "a long, b long, part_a long, part_b long").distinct()


def first_shared() -> Column:
    """The number of the first key that a and b have in common, if they have one."""
    both = F.col("a").bitwiseXOR(F.col("b"))
    found, before = F.lit(-1).cast("long"), sum(n for _, n in SEGMENTS)
    for first, length in reversed(SEGMENTS):
        before -= length
        x = F.shiftrightunsigned(both, first).bitwiseAND(F.lit((1 << length) - 1).cast("long"))
        bit = F.when(x == 0, 0).otherwise(F.bit_count(x - 1))
        found = F.when(F.bit_count(x) <= 1, (bit + before).cast("long")).otherwise(found)
    return found


def bridges(members: DataFrame) -> DataFrame:
    """All links between fingerprints of different parts; members: key, fp, part."""
    common = (members.groupBy("key", "part").agg(F.count("*").alias("n")).groupBy("key")
              .agg(F.max(F.struct("n", "part"))["part"].alias("common")))
    few = members.join(common, "key").filter("part <> common").select("key", F.col("fp").alias("a"), F.col("part").alias("part_a"))
    rest = members.select("key", F.col("fp").alias("b"), F.col("part").alias("part_b"))
    return few.join(rest, (few["key"] == rest["key"]) & (F.col("part_a") != F.col("part_b")) & (differing("a", "b") <= DISTANCE)
                    & (F.shiftright(few["key"], 22) == first_shared())).select("a", "b").distinct()


def links(nodes: DataFrame) -> DataFrame:
    """Enough of the pairs (a, b) within DISTANCE bits to connect every component; nodes: distinct fp."""
    first = stored(stars(nodes))
    labels = components(first).withColumnRenamed("node", "fp")
    members = stored(crowded(stored(nodes.join(labels, "fp", "left").select("fp", F.coalesce("label", "fp").alias("part")))))
    second = stored(neighbours(members))
    joined = components(second.select(F.col("part_a").alias("a"), F.col("part_b").alias("b"))).withColumnRenamed("node", "part")
    left = stored(members.join(joined, "part", "left").select("key", "fp", F.coalesce("label", "part").alias("part")))
    return first.union(second.select("a", "b")).union(bridges(left))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (hex) and component_id, the smallest id of the linked documents, per row."""
    prints = stored(fingerprints(docs, doc_id, text))
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = components(links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    placed = nodes.join(labels, "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("part"))
    names = placed.groupBy("part").agg(F.min("first").alias("component_id"))
    table = placed.join(names, "part").select("fp", "component_id")
    return prints.join(table, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose id names their component: one document of each group of near-duplicates.

    Rows that share an id are one document; the smallest row stays, if any row of the id names a
    component. Rows without an id cannot be named and stay.
    """
    found = near_duplicates(docs, doc_id, text)
    key = quoted(doc_id)
    ids = stored(found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.count("*").alias("n"), F.bool_or(F.col("doc_id") == F.col("component_id")).alias("named")))
    gone = ids.filter("NOT named OR n > 1").select(F.col("doc_id").alias("__id"))
    single = docs.join(gone, key == F.col("__id"), "left_anti")
    again = ids.filter("named AND n > 1").select(F.col("doc_id").alias("__id"))
    columns = [quoted(c) for c in docs.columns]
    repeated = (docs.join(again, key == F.col("__id"), "left_semi").groupBy(key.alias("__id"))
                .agg(F.min(F.struct(*columns)).alias("__row")).select("__row.*"))
    return single.union(repeated)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
