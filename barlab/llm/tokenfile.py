"""Token-id files: an adaptive context-mixing range coder over independent, checksummed blocks.

Documents are dealt into ascending ranges of ids, one shard each, and tokenized there. A shard's ids form one
stream that is cut into blocks of BLOCK ids. A block holds its alphabet and what it needs to be read alone: all
models start anew in it, and checksums cover its bytes and its ids. A file row is one block with the sizes of the documents in it.

Three models predict the next id: the last id seen after the previous two (order 2), the last id seen
after the previous one (order 1), and adaptive counts of the block's alphabet (order 0). What each of the first two
is worth is learned per confidence of both, and the three are mixed into one distribution that drives a
64-bit range coder with carries. Many blocks are coded side by side, one step of all at a time, in
numpy; the reader repeats the same steps.

Files are Parquet parts written and committed by Spark, so a lost executor's tasks are simply run again, and
they live wherever Spark can write. The payload is the coder's own; Parquet compression is off.

Defined cases: a null text is empty, and an empty text is its end id alone; rows with equal ids stay rows
of their own; null ids come first; a text that spans blocks is read from all of them; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlab.llm.common import documents, quoted, shared_folder, small_batches, text_of, written

BLOCK = 16384               # ids of a block
LANES = 768                 # blocks coded side by side
END = 2
MAGIC = b"TID1"
HASH = 4096                 # places of the order-2 table
REBUILD = 256               # ids between two updates of the order-0 sums
GAIN = 24                   # what an occurrence adds to its order-0 count
SURE = 3                    # the highest confidence
LIMIT = 512                 # a mixing count at which the counts of its context are halved
UNITS_KEPT, UNIT_CHARS = 300_000, 48     # texts from one white space to the next whose ids a task remembers, and the longest of these
# Without other white space, and without the separators that ``units`` puts in, a piece of the tokenizer holds white space in front alone.
OTHER_SPACE = re.compile("[\0\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
U64 = np.uint64
LOW32, SHIFT = U64(0xFFFFFFFF), U64(32)


class Models:
    """The predictions of many blocks, one lane each; ids are places in the lane's alphabet."""

    def __init__(self, sizes: np.ndarray):
        n, d = len(sizes), int(sizes.max())
        self.n, self.d = n, d
        self.lane = np.arange(n)
        self.counts = (np.arange(d)[None] < sizes[:, None]).astype(np.int32)
        self.sums = np.zeros((n, d + 1), np.int32)
        self.one, self.one_sure = np.zeros(n * d, np.int32), np.zeros(n * d, np.int8)
        self.two, self.two_sure = np.zeros(n * HASH, np.int32), np.zeros(n * HASH, np.int8)
        self.mix = np.tile(np.array([24, 8, 16], np.int32), (n * (SURE + 1) ** 2, 1))
        self.before, self.last = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.steps = 0

    def predict(self, a: int):
        """For the first ``a`` lanes: the two predicted ids and the weights of both and of order 0."""
        if self.steps % REBUILD == 0:
            np.cumsum(self.counts, axis=1, out=self.sums[:, 1:])
            self.total = self.sums[:, -1].copy()
        lane, last = self.lane[:a], self.last[:a]
        self.at1 = lane * self.d + last
        self.at2 = lane * HASH + ((self.before[:a] * 40503 + last * 31) & (HASH - 1))
        p1, s1 = self.one[self.at1], self.one_sure[self.at1]
        p2, s2 = self.two[self.at2], self.two_sure[self.at2]
        self.context = (lane * (SURE + 1) + s2) * (SURE + 1) + s1
        weights = self.mix[self.context].astype(np.int64)
        w2 = np.where(s2 > 0, weights[:, 0], 0)
        w1 = np.where((s1 > 0) & ((p1 != p2) | (s2 == 0)), weights[:, 1], 0)
        self.p1, self.s1, self.p2, self.s2 = p1, s1, p2, s2
        return p2, w2, p1, w1, weights[:, 2]

    def update(self, a: int, x: np.ndarray, outcome: np.ndarray) -> None:
        """outcome: 0 where order 2 was right, 1 where order 1 was, else 2."""
        self.mix[self.context, outcome] += 16
        full = np.flatnonzero(self.mix[self.context, outcome] > LIMIT)
        if len(full):
            rows = self.context[full]
            self.mix[rows] = (self.mix[rows] + 1) >> 1
        for table, sure, at, p, s in ((self.one, self.one_sure, self.at1, self.p1, self.s1), (self.two, self.two_sure, self.at2, self.p2, self.s2)):
            right = (p == x) & (s > 0)
            table[at] = x
            sure[at] = np.where(right, np.minimum(s + 1, SURE), 1)
        self.counts[self.lane[:a], x] += GAIN
        self.before[:a] = self.last[:a]
        self.last[:a] = x
        self.steps += 1


def active_lanes(lengths: np.ndarray) -> Iterator[int]:
    """How many of the lanes, longest first, still run at each step."""
    for n in range(int(lengths[0])):
        yield int(np.searchsorted(-lengths, -n, side="left"))


def code_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """The blocks' bytes, each readable alone; blocks are arrays of ids, none of them empty."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    alphabets, places = zip(*[np.unique(blocks[i], return_inverse=True) for i in order])
    lengths = np.array([len(p) for p in places])
    models = Models(np.array([len(a) for a in alphabets]))
    x_all = np.zeros((lengths[0], len(order)), np.int32)
    for i, p in enumerate(places):
        x_all[:len(p), i] = p
    low, span = np.zeros(len(order), U64), np.full(len(order), 0xFFFFFFFFFFFFFFFF, U64)
    words, used = np.zeros((len(order), int(lengths[0]) + 8), np.uint32), np.zeros(len(order), np.int64)
    for t, a in enumerate(active_lanes(lengths)):
        x = x_all[t, :a]
        p2, w2, p1, w1, w0 = models.predict(a)
        outcome = np.where((w2 > 0) & (p2 == x), 0, np.where((w1 > 0) & (p1 == x), 1, 2))
        lane, total0 = models.lane[:a], models.total[:a]
        start0 = models.sums[lane, x]
        start = np.choose(outcome, [0, w2 * total0, (w2 + w1) * total0 + w0 * start0])
        freq = np.choose(outcome, [w2 * total0, w1 * total0, w0 * (models.sums[lane, x + 1] - start0)])
        part = span[:a] // ((w2 + w1 + w0) * total0).astype(U64)
        moved = low[:a] + part * start.astype(U64)
        carried = np.flatnonzero(moved < low[:a])
        for i in carried:
            k = used[i] - 1
            while words[i, k] == 0xFFFFFFFF:
                words[i, k] = 0
                k -= 1
            words[i, k] += 1
        low[:a] = moved
        span[:a] = part * freq.astype(U64)
        small = np.flatnonzero(span[:a] <= LOW32)
        if len(small):
            words[small, used[small]] = (low[small] >> SHIFT).astype(np.uint32)
            used[small] += 1
            low[small] <<= SHIFT
            span[small] <<= SHIFT
        models.update(a, x, outcome)
    out: list[bytes] = [b""] * len(blocks)
    for i, at in enumerate(order):
        tail = np.array([low[i] >> SHIFT, low[i] & LOW32], U64).astype("<u4")
        ids = blocks[at].astype("<u4").tobytes()
        body = pack_alphabet(alphabets[i]) + words[i, :used[i]].astype("<u4").tobytes() + tail.tobytes()
        head = MAGIC + struct.pack("<3I", len(blocks[at]), len(alphabets[i]), zlib.crc32(ids))
        out[at] = head + body + struct.pack("<I", zlib.crc32(head + body))
    return out


def pack_alphabet(ids: np.ndarray) -> bytes:
    steps = np.diff(ids.astype(np.int64), prepend=-1) - 1
    return np.minimum(steps, 255).astype(np.uint8).tobytes() + steps[steps >= 255].astype("<u4").tobytes()


def unpack_alphabet(data: bytes, size: int) -> tuple[np.ndarray, int]:
    steps = np.frombuffer(data, np.uint8, size).astype(np.int64)
    far = np.flatnonzero(steps == 255)
    steps[far] = np.frombuffer(data, "<u4", len(far), size)
    return np.cumsum(steps + 1) - 1, size + 4 * len(far)


def read_blocks(payloads: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; a block whose checksums do not hold is an error."""
    heads = []
    for data in payloads:
        if data[:4] != MAGIC or zlib.crc32(data[:-4]) != struct.unpack_from("<I", data, len(data) - 4)[0]:
            raise ValueError("damaged block")
        heads.append(struct.unpack_from("<3I", data, 4))
    order = sorted(range(len(payloads)), key=lambda i: -heads[i][0])
    lengths = np.array([heads[i][0] for i in order])
    alphabets, streams = [], []
    for i in order:
        alphabet, used = unpack_alphabet(payloads[i][16:], heads[i][1])
        alphabets.append(alphabet)
        streams.append(np.frombuffer(payloads[i][16 + used:-4], "<u4"))
    models = Models(np.array([len(a) for a in alphabets]))
    words = np.zeros((len(order), max(map(len, streams)) + 2), np.uint32)
    for i, s in enumerate(streams):
        words[i, :len(s)] = s
    value = words[:, 0].astype(U64) << SHIFT | words[:, 1].astype(U64)
    span, used = np.full(len(order), 0xFFFFFFFFFFFFFFFF, U64), np.full(len(order), 2)
    x_all = np.zeros((int(lengths[0]), len(order)), np.int32)
    reach = max(1, int(models.d).bit_length())
    for t, a in enumerate(active_lanes(lengths)):
        p2, w2, p1, w1, w0 = models.predict(a)
        lane, total0 = models.lane[:a], models.total[:a]
        part = span[:a] // ((w2 + w1 + w0) * total0).astype(U64)
        mark = np.minimum((value[:a] // part).astype(np.int64), (w2 + w1 + w0) * total0 - 1)
        edge2, edge1 = w2 * total0, (w2 + w1) * total0
        outcome = np.where(mark < edge2, 0, np.where(mark < edge1, 1, 2))
        target = np.maximum(mark - edge1, 0) // w0
        low, high = np.zeros(a, np.int64), np.full(a, models.d)
        for _ in range(reach):                                  # the last place whose sum is not beyond the target
            middle = (low + high) >> 1
            right = models.sums[lane, middle] <= target
            low, high = np.where(right, middle, low), np.where(right, high, middle)
        x = np.choose(outcome, [p2, p1, low])
        start0 = models.sums[lane, x]
        start = np.choose(outcome, [0, edge2, edge1 + w0 * start0])
        freq = np.choose(outcome, [edge2, w1 * total0, w0 * (models.sums[lane, x + 1] - start0)])
        value[:a] -= part * start.astype(U64)
        span[:a] = part * freq.astype(U64)
        small = np.flatnonzero(span[:a] <= LOW32)
        if len(small):
            value[small] = value[small] << SHIFT | words[small, used[small]].astype(U64)
            used[small] += 1
            span[small] <<= SHIFT
        x_all[t, :a] = x
        models.update(a, x, outcome)
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(payloads)
    for i, at in enumerate(order):
        ids = alphabets[i][x_all[:lengths[i], i]].astype("<u4")
        if zlib.crc32(ids.tobytes()) != heads[at][2]:
            raise ValueError("damaged block")
        out[at] = ids
    return out


def units(text: str) -> list[str]:
    """The text, cut before each run of white space; these parts are tokenized alike alone and together."""
    cut = text.replace(" ", "\0 ").replace("\n", "\0\n").replace(" \0", " ").replace("\n\0", "\n")
    return cut.split("\0")


class Encoder:
    """The library's ids of whole texts: each distinct unit is encoded once as long as it is remembered.

    That holds for a byte-level tokenizer that neither normalizes nor puts anything before a text; with any other one, and for texts with
    special tokens or white space besides spaces and line ends, whole texts go to the library.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        form = json.loads(spec)
        before = form.get("pre_tokenizer") or {}
        self.by_units = (before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
                         and not any(form.get(k) for k in ("normalizer", "truncation", "padding")) and form["model"]["type"] == "BPE"
                         and not form["model"].get("dropout"))
        self.special = [t["content"] for t in form.get("added_tokens", [])]
        self.known: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        """For each text its ids (little-endian, four bytes each)."""
        out: list[bytes | None] = [None] * len(texts)
        cut = [i for i, t in enumerate(texts) if self.by_units and not OTHER_SPACE.search(t) and not any(x in t for x in self.special)]
        found = [units(texts[i]) for i in cut]
        if len(self.known) > UNITS_KEPT:
            self.known.clear()
        new: set[str] = set()
        for parts in found:
            new.update(parts)
        new.difference_update(self.known)
        asked = [*new]
        self.known.update(zip(asked, self.encoded(asked)))
        get = self.known.__getitem__
        for i, parts in zip(cut, found):
            out[i] = b"".join(map(get, parts))
        for unit in asked:
            if len(unit) > UNIT_CHARS:
                del self.known[unit]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self.encoded([texts[i] for i in rest])):
            out[i] = ids
        return out

    def encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)] if texts else []


# -- files -------------------------------------------------------------------------------------------------------

FILE = ("shard int, block int, first_token long, n_tokens int, first_doc long, doc_ids array<{id}>, sizes array<int>, "
        "begins boolean, ends boolean, payload binary")


def blocks_of(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end: int = END) -> DataFrame:
    """The rows of the files. ``first_doc`` numbers a shard's documents, ``sizes`` are their ids in this block, and
    ``begins`` and ``ends`` tell whether the block holds the first one's begin and the last one's end."""
    small_batches(docs.sparkSession)
    with open(tokenizer, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(quoted(doc_id).alias("doc_id"), text_of(text).alias("text"))
    key = ["doc_id", F.xxhash64("text")]
    ranged = rows.repartitionByRange(*key).sortWithinPartitions(*key)
    schema = FILE.format(id=dict(rows.dtypes)["doc_id"])
    id_type = ranged.select("doc_id").limit(0).toArrow().schema.field("doc_id").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder, shard = Encoder(sent.value), TaskContext.get().partitionId()
        pending: list[tuple[object, np.ndarray]] = []       # documents, or what is left of one, not yet in a block
        ready: list[tuple] = []                             # blocks not yet coded
        state = {"held": 0, "block": 0, "token": 0, "doc": 0, "begins": True}

        def cut(size: int) -> None:
            """Moves the next ``size`` ids into a block."""
            names, parts, left, begins, first = [], [], size, state["begins"], state["doc"]
            while left:
                name, ids = pending[0]
                take = min(left, len(ids))
                names.append(name)
                parts.append(ids[:take])
                left -= take
                if take == len(ids):
                    pending.pop(0)
                    state["doc"] += 1
                    state["begins"] = True
                else:
                    pending[0] = (name, ids[take:])
                    state["begins"] = False
            ready.append((state["block"], state["token"], first, names, [len(p) for p in parts], begins, state["begins"], np.concatenate(parts)))
            state["block"] += 1
            state["token"] += size
            state["held"] -= size

        def coded() -> pa.RecordBatch:
            payloads = code_blocks([r[-1] for r in ready]) if ready else []
            columns = list(zip(*ready)) or [[] for _ in range(8)]
            batch = pa.RecordBatch.from_arrays([
                pa.array([shard] * len(ready), pa.int32()), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()),
                pa.array([len(b) for b in columns[7]], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.list_(id_type)),
                pa.array(columns[4], pa.list_(pa.int32())), pa.array(columns[5], pa.bool_()), pa.array(columns[6], pa.bool_()),
                pa.array(payloads, pa.binary())],
                names=["shard", "block", "first_token", "n_tokens", "first_doc", "doc_ids", "sizes", "begins", "ends", "payload"])
            ready.clear()
            return batch

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for name, raw in zip(part.column(0).to_pylist(), coder.ids(part.column(1).to_pylist())):
                    ids = np.frombuffer(raw + struct.pack("<I", end), "<u4")
                    pending.append((name, ids))
                    state["held"] += len(ids)
                while state["held"] >= BLOCK:
                    cut(BLOCK)
                    if len(ready) == LANES:
                        yield coded()
        if state["held"]:
            cut(state["held"])
        if ready:
            yield coded()

    return ranged.mapInArrow(run, schema)


def write(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end: int = END) -> None:
    blocks_of(docs, tokenizer, doc_id, text, end).write.option("compression", "uncompressed").parquet(path)


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """shard, doc (number in its shard), block, doc_id, at (first id in the shard), n, crc, whole: each document's part in each block."""
    files = spark.read.parquet(path)
    id_type = dict(files.dtypes)["doc_ids"][len("array<"):-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, LANES):
                part = batch.slice(at, LANES)
                rows = part.to_pylist()
                shard, doc, block, names, first, size, crc, whole = ([] for _ in range(8))
                for r, ids in zip(rows, read_blocks([r["payload"] for r in rows])):
                    raw, k, last = memoryview(ids.tobytes()), 0, len(r["sizes"]) - 1
                    for j, n in enumerate(r["sizes"]):
                        shard.append(r["shard"])
                        doc.append(r["first_doc"] + j)
                        block.append(r["block"])
                        names.append(r["doc_ids"][j])
                        first.append(r["first_token"] + k)
                        size.append(n)
                        crc.append(zlib.crc32(raw[4 * k:4 * (k + n)]))
                        whole.append((j > 0 or r["begins"]) and (j < last or r["ends"]))
                        k += n
                yield pa.RecordBatch.from_arrays([
                    pa.array(shard, pa.int32()), pa.array(doc, pa.int64()), pa.array(block, pa.int32()),
                    pa.array(names, part.schema.field("doc_ids").type.value_type), pa.array(first, pa.int64()), pa.array(size, pa.int64()),
                    pa.array(crc, pa.int64()), pa.array(whole, pa.bool_())], names=["shard", "doc", "block", "doc_id", "at", "n", "crc", "whole"])

    return files.select("shard", "block", "first_token", "first_doc", "doc_ids", "sizes", "begins", "ends", "payload").mapInArrow(
        run, f"shard int, doc long, block int, doc_id {id_type}, at long, n long, crc long, whole boolean")


def joined_crc(a: int, b: int, size: int) -> int:
    """CRC-32 of two strings from the CRC of each and the second's bytes: the first is moved on by as many zero bytes,
    by squaring the step of one zero bit."""
    times = lambda m, v: _sum_rows(m, v)
    step = [0xEDB88320] + [1 << i for i in range(31)]
    for _ in range(3):
        step = [times(step, r) for r in step]               # one byte
    while size:
        if size & 1:
            a = times(step, a)
        step = [times(step, r) for r in step]
        size >>= 1
    return a ^ b


def _sum_rows(rows: list[int], value: int) -> int:
    total, i = 0, 0
    while value:
        if value & 1:
            total ^= rows[i]
        value >>= 1
        i += 1
    return total


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 per document, from the files alone."""
    pieces = written(read_pieces(spark, path), "pieces")        # each block is decoded once
    sizes = spark.read.parquet(path).groupBy("shard").agg(F.sum("n_tokens").alias("size"))      # a row per shard
    base = sizes.select("shard", (F.sum("size").over(Window.orderBy("shard")) - F.col("size")).alias("base"))
    spanning = (pieces.filter("NOT whole").groupBy("shard", "doc").agg(
        F.first("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n").alias("n"),
        F.sort_array(F.collect_list(F.struct("block", "n", "crc"))).alias("parts")))
    id_type = dict(pieces.dtypes)["doc_id"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = []
            for parts in batch.column(4).to_pylist():
                crc = parts[0]["crc"]
                for p in parts[1:]:
                    crc = joined_crc(crc, p["crc"], 4 * p["n"])
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crcs, pa.int64())], names=["shard", "doc_id", "at", "n", "crc"])

    long_docs = spanning.select("shard", "doc_id", "at", "n", "parts").mapInArrow(join, f"shard int, doc_id {id_type}, at long, n long, crc long")
    every = pieces.filter("whole").select("shard", "doc_id", "at", "n", "crc").union(long_docs)
    return every.join(F.broadcast(base), "shard").select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_folder(spark, "tokens")
    write(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(spark, path)
