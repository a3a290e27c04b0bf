"""Spelling variants by a dictionary of pairs of trie nodes.

The distinct words are sorted and become a trie: every prefix is a node with a number. The reversed words, sorted,
number every suffix in the same way. A word and a place in it give two pairs of numbers: (prefix node, suffix node)
around a gap between two letters, and the pair around one letter left out. Two words are one replacement apart if
they share a pair with a letter left out, and one insertion apart if the gap of the shorter is the pair with
a letter left out of the longer. So equality of integer pairs gives exact neighbours.

The words that share a pair differ in one letter, so a pair has no more of them than the alphabet has letters (26 + 64),
plus one with a gap there. Each pair is read once and tells each of its words how many neighbours it has there and which of
them has the largest count; no pairs of words are formed. In a run of equal letters only the first may
be left out for an insertion, so each neighbour is counted once.

Tries are numbered where the sorted words lie: each partition numbers the nodes that its words open, and the
driver joins the partitions by one path each (the nodes of the last word), so no partition needs another's words.

Defined cases: a null text has no runs; a null id is read as the word null; rows that share an id count each;
a deletion may leave no or few letters, and such a result counts only if it is long enough; ties of n go to the
smaller word; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.llm.common import documents, quoted, stored, text_of

RUN = re.compile("[A-Za-zÀ-ÿ]+")
TYPO = 199              # a run whose hash it divides loses a letter
LETTERS = 6             # least length of a word
TIMES = 5               # least occurrences of a word
RATIO = 5               # a form occurs at least so many times as often
HELD = 200_000          # distinct words a task holds before it passes counts on


def changed(doc_id: str, run: str, typo: int) -> str:
    """The run as it is counted for this document."""
    h = crc32(f"{doc_id}:{run}".encode())
    if h % typo:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def tallied(typo: int, letters: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def passed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for one, text in zip(batch.column(0), batch.column(1)):
                name = f"{one.as_py()}:" if one.is_valid else "null:"
                start = crc32(name.encode())
                runs = Counter(RUN.findall(text.as_py().lower().decode()))      # bytes: A-Z alone
                for run, n in runs.items():
                    if crc32(run.encode(), start) % typo == 0:
                        run = changed(name[:-1], run, typo)
                    if len(run) >= letters:
                        counts[run] += n
                if len(counts) > HELD:
                    yield passed()
        yield passed()
    return read


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", typo: int = TYPO, letters: int = LETTERS, times: int = TIMES) -> DataFrame:
    """word, n: the words and their occurrences in all texts."""
    rows = docs.select(quoted(doc_id).cast("string").alias("doc_id"), text_of(text).cast("binary").alias("text"))
    return (rows.mapInArrow(tallied(typo, letters), "word string, n long").groupBy("word")
            .agg(F.sum("n").alias("n")).filter(F.col("n") >= times))


def shared_letters(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def paths(words: list[str], path: list[int], last: str, base: int) -> Iterator[list[int]]:
    """The nodes of each of the sorted words, by depth, after a word whose nodes are ``path``; new nodes count on from ``base``."""
    for word in words:
        kept = shared_letters(last, word) + 1 if path else 0
        path = path[:kept] + list(range(base, base + len(word) + 1 - kept))
        base += len(word) + 1 - kept
        last = word
        yield path


def surveyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: part, the first and the last word of the partition, the last word's nodes as numbered alone, and how many there are."""
    part, first, last, path, base = TaskContext.get().partitionId(), None, "", [], 0
    for batch in batches:
        words = batch.column(0).to_pylist()
        if not words:
            continue
        first = words[0] if first is None else first
        for path in paths(words, path, last, base):
            base = max(base, path[-1] + 1)
        last = words[-1]
    if first is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, first, last)] + [pa.array([path], pa.list_(pa.int64())), pa.array([base], pa.int64())],
                                         names=["part", "first", "last", "path", "size"])


def joined(parts: list) -> dict[int, tuple[list[int], str, int]]:
    """Per partition: the nodes and the letters of the word before it, and the first number that is its own."""
    out, path, last, base = {}, [], "", 0
    for p in parts:
        out[p["part"]] = (path, last, base)
        kept = shared_letters(last, p["first"]) + 1 if path else 0
        path = [path[x] if x < kept else base + x - kept for x in p["path"]]      # the first word's nodes are numbered by depth; shared ones are not numbered anew
        last, base = p["last"], base + p["size"] - kept
    return out


def numbered(starts: dict[int, tuple[list[int], str, int]]):
    """word, nodes: the number of every prefix of each word, the empty one and the whole word included."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, last, base = starts.get(TaskContext.get().partitionId(), ([], "", 0))
        for batch in batches:
            words = batch.column(0).to_pylist()
            found = []
            for path in paths(words, path, last, base):
                base = max(base, path[-1] + 1)
                found.append(path)
            last = words[-1] if words else last
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["word", "nodes"])
    return run


def trie(words: DataFrame) -> DataFrame:
    """word, nodes of a table of distinct words."""
    ordered = stored(words.repartitionByRange("word").sortWithinPartitions("word"))
    parts = ordered.mapInArrow(surveyed, "part long, first string, last string, path array<long>, size long").collect()   # one row a partition
    return ordered.mapInArrow(numbered(joined(sorted(parts, key=lambda p: p["part"]))), "word string, nodes array<long>")


def pairs(words: DataFrame) -> DataFrame:
    """p, s, x (word, n, left_out, opens): the pairs of nodes of every word; words: distinct word, n.

    left_out: a letter between the nodes is left out; opens: it is the first of its run of equal letters.
    """
    forward = trie(words.select("word")).withColumnRenamed("nodes", "heads")
    backward = trie(words.select(F.reverse("word").alias("word"))).select(F.reverse("word").alias("word"), F.reverse("nodes").alias("tails"))
    both = words.join(forward, "word").join(backward, "word")
    size = F.length("word")
    around = lambda i, j, left_out, opens: F.struct(
        F.get("heads", i).alias("p"), F.get("tails", j).alias("s"), F.lit(left_out).alias("left_out"), opens.alias("opens"))
    letter = lambda i: F.substring(F.col("word"), i + 1, F.lit(1))
    gaps = F.transform(F.sequence(F.lit(0), size), lambda i: around(i, i, False, F.lit(False)))
    skips = F.transform(F.sequence(F.lit(0), size - 1), lambda i: around(i, i + 1, True, (i == 0) | (letter(i) != letter(i - 1))))
    return both.select("word", "n", F.explode(F.concat(gaps, skips)).alias("k")).select(
        "k.p", "k.s", F.struct("word", "n", "k.left_out", "k.opens").alias("x"))


def neighbours(words: DataFrame) -> DataFrame:
    """word, n_near, best (n, word): for words with a neighbour; of the largest n the smallest word."""
    met = pairs(words).groupBy("p", "s").agg(F.collect_list("x").alias("xs")).filter(F.size("xs") > 1)     # at most one per letter, and one
    met = met.select(F.array_sort("xs", lambda a, b: F.when(a["n"] != b["n"], F.when(a["n"] > b["n"], -1).otherwise(1))
                                  .when(a["word"] < b["word"], -1).when(a["word"] > b["word"], 1).otherwise(0)).alias("xs"))
    other = lambda x, y: (x["word"] != y["word"]) & ((x["left_out"] & y["left_out"]) | (x["left_out"] & x["opens"]) & ~y["left_out"]
                                                     | (y["left_out"] & y["opens"]) & ~x["left_out"])
    told = met.select(F.explode(F.transform("xs", lambda x: F.struct(x["word"].alias("word"), F.filter("xs", lambda y: other(x, y)).alias("near")))).alias("t"))
    first = F.col("t.near")[0]
    return (told.filter(F.size("t.near") > 0).groupBy("t.word").agg(
        F.sum(F.size("t.near")).alias("n_near"), F.min(F.struct((-first["n"]).alias("n"), first["word"].alias("word"))).alias("best"))
        .select("word", "n_near", F.struct((-F.col("best.n")).alias("n"), F.col("best.word").alias("word")).alias("best")))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of the chain of forms of every word that has one; forms: word, form.

    Counts grow by RATIO at each step, so chains end and are short; each round doubles the steps taken.
    """
    chains = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = chains.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = stored(chains.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not stepped.filter("moved").limit(1).count():
            return stepped.select("word", "root")
        chains = stepped.select("word", "root")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", typo: int = TYPO, letters: int = LETTERS, times: int = TIMES,
             ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word."""
    words = stored(vocabulary(docs, doc_id, text, typo, letters, times))
    near = neighbours(words)
    found = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("best.n") >= ratio * F.col("n"), F.col("best")).alias("form")))
    ends = roots(found.filter("form IS NOT NULL").select("word", F.col("form.word").alias("form")))
    return found.join(ends, "word", "left").select(
        "word", F.col("form.word").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", F.col("form.n").alias("form_n"))


def op11_trie_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir))
