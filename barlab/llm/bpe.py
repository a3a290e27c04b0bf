"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

The words of all documents are counted, and the most frequent ones are compiled, with the ids that
the tokenizer's merges give them, into a minimal acyclic automaton: words are added in sorted order and
finished suffixes are shared, and arcs carry additive outputs whose sum along a word is its number in
the table of id sequences. The automaton is a flat file that each Python worker maps into memory.
Words outside it are merged exactly, pair by pair in rank order. What is in the lexicon
therefore changes the speed only.

The tokenizer is one with byte-level symbols and word ends: special tokens are cut out of the raw
text, the rest is put into NFC and lower case letter by letter, and split into pieces that never
hold white space. Text between white space is therefore encoded on its own, and each worker remembers the ids of a
bounded number of such chunks. Those of some texts that are not remembered are encoded together: their words
take the steps through the automaton, and the merges beyond it, side by side in numpy.

Defined cases: a null text is empty and has no ids; a null id stays a row; repeated rows stay rows;
an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import mmap
import os
import re
import struct
import tempfile
import unicodedata
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.llm.common import REMEMBERED, documents, quoted, small_batches, stored, text_of

LEXICON_WORDS = 1 << 18      # words in the automaton
WORD_BYTES = 48             # longer words are always merged
CHUNKS_KEPT = 200_000       # recent chunks that a worker remembers
WORDS_KEPT = 100_000        # recent words
COUNTED = 400_000           # chunks that a worker counts before it hands them on
CHUNK_CHARS = 48
ROWS_OUT = 128
SIDE_BY_SIDE = 4096         # words merged together
LONG_WORD = 300
NO_MERGE = 1 << 62

PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
MARK = "\x01"       # stands for characters without a category, some of which the pattern's library takes for letters
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACE = re.compile("[" + "".join(map(chr, WHITE)) + "]+")
PUNCTUATION = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
FAR = re.compile("[^\x00-\u024f]")          # beyond the first blocks, whose characters all have a category
SEPARATORS = re.compile("[\x1c-\x1f]")      # str.split takes these as white space, the tokenizer does not


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]


class Model:
    """Vocabulary and merges as tables of ids; small enough to be sent to every task."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + end] for s in symbols]
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(vocab[a] << 20 | vocab[b], rank << 20 | vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {**vocab, **self.special}
        self.tokens = [""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.tokens[i] = name

    def merge(self, word: bytes) -> list[int]:
        """Ids of a word: of all neighbours the pair of the lowest rank, leftmost first, is joined until none is left."""
        if not word:
            return []
        ids = [self.inner[b] for b in word[:-1]] + [self.last[word[-1]]]
        if len(ids) > LONG_WORD:
            return self.merge_long(ids)
        get, none = self.merges.get, NO_MERGE
        found = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best == none:
                break
            i = found.index(best)
            ids[i:i + 2] = [best & 0xFFFFF]
            del found[i]
            if i:
                found[i - 1] = get(ids[i - 1] << 20 | ids[i], none)
            if i < len(found):
                found[i] = get(ids[i] << 20 | ids[i + 1], none)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same in time n log n: a heap of pairs, in which those that have changed since are passed over."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges, heap = self.merges, []

        def offer(i: int, j: int) -> None:
            if (m := merges.get(ids[i] << 20 | ids[j])) is not None:
                heapq.heappush(heap, (m >> 20, i, m & 0xFFFFF, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                offer(i, k)
            if before[i] >= 0:
                offer(before[i], i)
        return [i for i in ids if i >= 0]

    def pair_table(self) -> tuple[np.ndarray, np.ndarray]:
        """The pairs in ascending order and what each becomes, rank first."""
        pairs = np.fromiter(self.merges, np.int64, len(self.merges))
        order = np.argsort(pairs)
        return pairs[order], np.fromiter(self.merges.values(), np.int64, len(self.merges))[order]


def matrix(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes, a row each, zeros behind them, and their lengths."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    wide = np.zeros((len(words), int(sizes.max())), np.uint8)
    wide[np.arange(wide.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(words), np.uint8)
    return wide, sizes


class Merger:
    """``Model.merge`` for many words side by side."""

    def __init__(self, model: Model):
        self.model = model
        self.inner, self.last = np.array(model.inner, np.int64), np.array(model.last, np.int64)
        self.pairs, self.made = model.pair_table()

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.pairs):
            return np.full(a.shape, NO_MERGE)
        pair = np.where(b < 0, -1, a << 20 | b)
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.made[at], NO_MERGE)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The bytes of each word's ids; none of the words is empty."""
        out = [b""] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        while order and len(words[order[-1]]) > WORD_BYTES:
            i = order.pop()
            out[i] = array("I", self.model.merge(words[i])).tobytes()
        for start in range(0, len(order), SIDE_BY_SIDE):
            part = order[start:start + SIDE_BY_SIDE]
            for i, ids in zip(part, self.merged([words[i] for i in part])):
                out[i] = ids
        return out

    def merged(self, words: list[bytes]) -> list[bytes]:
        wide, sizes = matrix(words)
        n, columns = len(words), np.arange(wide.shape[1] + 1)
        ids = np.full((n, wide.shape[1] + 1), -1, np.int64)
        ids[:, :-1] = np.where(columns[:-1] < sizes[:, None], self.inner[wide], -1)
        ids[np.arange(n), sizes - 1] = self.last[wide[np.arange(n), sizes - 1]]
        found = self.lookup(ids[:, :-1], ids[:, 1:])
        rows, done = np.arange(n), np.full(ids.shape, -1, np.int64)
        while len(rows):
            every = np.arange(len(rows))
            best = found.argmin(1)              # the leftmost of the lowest rank
            value = found[every, best]
            ended = value == NO_MERGE
            if ended.any():
                done[rows[ended], :ids.shape[1]] = ids[ended]
                rows, ids, found, best, value = (x[~ended] for x in (rows, ids, found, best, value))
                every = np.arange(len(rows))
            ids[every, best] = value & 0xFFFFF
            gone = columns[:-1] >= best[:, None] + 1        # what stands behind the pair moves up
            ids[:, :-1] = np.where(gone, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            gone = columns[:-2] >= best[:, None]
            found[:, :-1] = np.where(gone, found[:, 1:], found[:, :-1])
            found[:, -1] = NO_MERGE
            found[every, best] = self.lookup(ids[every, best], ids[every, best + 1])
            left = np.flatnonzero(best)
            at = best[left] - 1
            found[left, at] = self.lookup(ids[left, at], ids[left, at + 1])
        kept = done >= 0
        ends = np.cumsum(kept.sum(1)) * 4
        raw = done[kept].astype("<u4").tobytes()
        return [raw[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]


def compile_lexicon(words: list[bytes], model: Model) -> bytes:
    """The file of the minimal automaton over the distinct words.

    Layout: a header of five counts; per state its first arc, with the end as a last entry; per state
    whether a word ends there; per arc its label, target and output; per word the start of its ids; the ids.
    """
    words = sorted(set(words))
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []           # whether final, arcs of (label, target)
    counts: list[int] = []                          # words from a state on

    def settle(final: bool, arcs: list) -> int:
        key = (final, tuple(arcs))
        if key not in register:
            register[key] = len(states)
            states.append(key)
            counts.append(final + sum(counts[t] for _, t in arcs))
        return register[key]

    path: list[list] = [[False, []]]                # unfinished states along the last word
    last = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, arcs = path.pop()
            path[-1][1].append((last[len(path) - 1], settle(final, arcs)))

    for word in words:
        shared = len(os.path.commonprefix([last, word]))
        close(shared)
        path.extend([False, []] for _ in range(len(word) - shared))
        path[-1][0] = True
        last = word
    close(0)
    start = settle(*path[0])
    first, labels, targets, outputs = array("I"), bytearray(), array("I"), array("I")
    for final, arcs in states:
        first.append(len(labels))
        number = int(final)
        for label, target in arcs:
            labels.append(label)
            targets.append(target)
            outputs.append(number)
            number += counts[target]
    first.append(len(labels))
    offsets, ids = array("I", [0]), array("I")
    for word in words:
        ids.extend(model.merge(word))
        offsets.append(len(ids))
    finals = bytes(final for final, _ in states)
    pad = lambda b: bytes(b) + b"\0" * (-len(b) % 4)
    return b"".join([struct.pack("<5I", len(states), len(labels), start, len(words), len(ids)), first.tobytes(), targets.tobytes(),
                     outputs.tobytes(), offsets.tobytes(), ids.tobytes(), pad(finals), pad(labels)])


class Lexicon:
    """A compiled automaton, mapped from a file that is gone from the folder once it is open."""

    def __init__(self, content: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(content)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        states, arcs, self.start, words, ids = struct.unpack_from("<5I", self.map)
        at, view, parts = 20, memoryview(self.map), []
        for n in (states + 1, arcs, arcs, words + 1, ids):
            parts.append(view[at:at + 4 * n].cast("I"))
            at += 4 * n
        self.first, self.targets, self.outputs, self.offsets, self.ids = parts
        self.finals, self.labels = at, at + states + (-states % 4)
        first = np.frombuffer(self.first, np.uint32).astype(np.int64)
        self.keys = np.repeat(np.arange(states) << 8, np.diff(first)) | np.frombuffer(self.map, np.uint8, arcs, self.labels)     # arcs by state and label

    def get(self, word: bytes):
        """The ids of a word, or None where the automaton doesn't hold it."""
        state, number, labels, first, find = self.start, 0, self.labels, self.first, self.map.find
        for i in range(len(word)):
            arc = find(word[i:i + 1], labels + first[state], labels + first[state + 1])
            if arc < 0:
                return None
            arc -= labels
            number += self.outputs[arc]
            state = self.targets[arc]
        if not self.map[self.finals + state]:
            return None
        return self.ids[self.offsets[number]:self.offsets[number + 1]]

    def find(self, words: list[bytes]) -> list[bytes | None]:
        """For each word the bytes of its ids, or None where the automaton doesn't hold it; the words step side by side."""
        if not words or not len(self.keys):
            return [None if (ids := self.get(w)) is None else ids.tobytes() for w in words]
        wide, sizes = matrix(words)
        targets, outputs = np.frombuffer(self.targets, np.uint32), np.frombuffer(self.outputs, np.uint32)
        state, number, known = np.full(len(words), self.start, np.int64), np.zeros(len(words), np.int64), np.ones(len(words), bool)
        for k in range(wide.shape[1]):
            rows = np.flatnonzero(known & (sizes > k))
            key = state[rows] << 8 | wide[rows, k]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            right = self.keys[arc] == key
            known[rows[~right]] = False
            rows, arc = rows[right], arc[right]
            number[rows] += outputs[arc]
            state[rows] = targets[arc]
        known &= np.frombuffer(self.map, np.uint8, len(self.first) - 1, self.finals)[state] > 0
        offsets, ids = self.offsets, self.ids
        return [ids[offsets[i]:offsets[i + 1]].tobytes() if ok else None for ok, i in zip(known.tolist(), number.tolist())]


def pieces(chunk: str) -> list[str]:
    """The tokenizer's pieces of a text without special tokens; lower case is taken letter by letter."""
    if not chunk.isascii():
        chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")     # no word-final form
    chunk = chunk.lower()
    if chunk.isalpha():
        return [chunk]
    if (word := chunk.rstrip(PUNCTUATION)).isalpha():
        return [word, chunk[len(word):]]
    if not FAR.search(chunk) or not any(unicodedata.category(c) == "Cn" for c in chunk):
        return PIECES.findall(chunk)
    found, at = [], 0
    for piece in PIECES.findall("".join(MARK if unicodedata.category(c) == "Cn" else c for c in chunk)):
        found.append(chunk[at:at + len(piece)])
        at += len(piece)
    return found


def chunks(text: str) -> list[str]:
    if SEPARATORS.search(text):
        return [c for c in SPACE.split(text) if c]
    return text.split()


class Recent:
    """Remembers the values of the latest keys up to a length: some ``most`` to twice as many."""

    def __init__(self, longest: int, most: int):
        self.longest, self.most, self.now, self.older = longest, most, {}, {}

    def all(self, keys: list[str], make) -> list[bytes]:
        """The value of each key; those that are not remembered come from ``make``, which gets each of these once."""
        found = [*map(self.now.get, keys)]
        blank = [i for i, x in enumerate(found) if x is None]
        if blank:
            asked, older = [keys[i] for i in blank], self.older.get
            new = {key: older(key) for key in asked}
            unknown = [key for key, x in new.items() if x is None]
            new.update(zip(unknown, make(unknown)))
            for i, key in zip(blank, asked):
                found[i] = new[key]
            if len(self.now) >= self.most:
                self.older, self.now = self.now, {}
            self.now.update((key, x) for key, x in new.items() if len(key) <= self.longest)
        return found


class Codec:
    """Encodes and decodes texts."""

    def __init__(self, model: Model, lexicon: Lexicon):
        self.model, self.lexicon, self.merger = model, lexicon, Merger(model)
        self.special = re.compile("(" + "|".join(map(re.escape, model.special)) + ")") if model.special else None
        self.fixed = {name: struct.pack("<I", i) for name, i in model.special.items()}
        self.tokens = pa.array(model.tokens, pa.string())
        self.words, self.chunks = Recent(WORD_BYTES, WORDS_KEPT), Recent(CHUNK_CHARS, CHUNKS_KEPT)

    def encode_words(self, found: list[str]) -> list[bytes]:
        """The bytes of each piece's ids."""
        words = [x.encode("utf-8", "surrogatepass") for x in found]
        short = [i for i, w in enumerate(words) if len(w) <= WORD_BYTES]
        out: list[bytes | None] = [None] * len(words)
        for i, ids in zip(short, self.lexicon.find([words[i] for i in short])):
            out[i] = ids
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self.merger.merge([words[i] for i in rest])):
            out[i] = ids
        return out

    def encode_chunks(self, found: list[str]) -> list[bytes]:
        """The same for texts without white space: the ids of their pieces, one after the other; a special token is its own id."""
        parts = [[] if c in self.fixed else pieces(c) for c in found]
        ids = iter(self.words.all([*chain.from_iterable(parts)], self.encode_words))
        return [next(ids) if len(part) == 1 else b"".join(islice(ids, len(part))) if part else self.fixed.get(c, b"")
                for c, part in zip(found, parts)]

    def decode(self, ids: list[bytes]) -> pa.Array:
        """Texts of ids as the tokenizer without a decoder has them: their tokens, joined by spaces."""
        ends = np.cumsum([0, *map(len, ids)]) // 4
        tokens = self.tokens.take(pa.array(np.frombuffer(b"".join(ids), "<u4")))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens), " ")

    def run_all(self, texts: list[str]) -> tuple[list[bytes], pa.Array]:
        """For each text the ids' bytes (little-endian, four each) and the text that they decode to."""
        found, ends = [], [0]
        for text in texts:
            if self.special and "<|" in text:
                for k, part in enumerate(self.special.split(text)):
                    found.extend([part] if k % 2 else chunks(part))
            else:
                found.extend(chunks(text))
            ends.append(len(found))
        ids = self.chunks.all(found, self.encode_chunks)
        done = [b"".join(ids[a:b]) for a, b in zip(ends, ends[1:])]
        return done, self.decode(done)

    def run(self, text: str) -> tuple[bytes, str]:
        """The same for one text."""
        ids, decoded = self.run_all([text])
        return ids[0], decoded[0].as_py()


LAST_CODEC: list[tuple[str, Codec]] = []
REMEMBERED.append(LAST_CODEC)


def codec_of(key: str, sent) -> Codec:
    """The worker's codec of a lexicon, with what it remembers from earlier tasks; a new lexicon takes its place."""
    if not LAST_CODEC or LAST_CODEC[0][0] != key:
        model, content = sent.value
        LAST_CODEC[:] = [(key, Codec(model, Lexicon(content)))]
    return LAST_CODEC[0][1]


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """word (binary), n: how often each piece occurs in all documents. Words beyond WORD_BYTES are left to merging."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush():
            words: Counter = Counter()
            for chunk, n in seen.items():
                for piece in pieces(chunk):
                    words[piece] += n
            seen.clear()
            kept = [(w, n) for p, n in words.items() if len(w := p.encode("utf-8", "surrogatepass")) <= WORD_BYTES]
            return pa.record_batch({"word": pa.array([w for w, _ in kept], pa.binary()), "n": pa.array([n for _, n in kept], pa.int64())})

        for batch in batches:
            for value in batch.column(0):
                seen.update(chunks(value.as_py()))
                if len(seen) >= COUNTED:
                    yield flush()
        yield flush()

    return (docs.select(text_of(text).alias("text")).mapInArrow(run, "word binary, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def frequent_words(docs: DataFrame, words: int = LEXICON_WORDS, text: str = "text") -> list[bytes]:
    """At most ``words`` words: the most frequent ones, down to the last count step that leaves no more than that.
    A step is an eighth of a power of two; the number of words per step comes first, so that no task sends more
    than is kept. A word that occurs once is not frequent.
    """
    counts = stored(count_words(docs, text).filter("n > 1").withColumn("step", F.floor(F.log2("n") * 8).cast("int")))
    total, least = 0, None
    for r in counts.groupBy("step").count().orderBy(F.desc("step")).collect():      # a few hundred steps at most
        total += r["count"]
        if total > words:
            break
        least = r["step"]
    return [] if least is None else [bytes(r["word"]) for r in counts.filter(F.col("step") >= least).select("word").collect()]


def encode(docs: DataFrame, tokenizer: str, words: int = LEXICON_WORDS, doc_id: str = "doc_id", text: str = "text",
           keep: tuple[str, ...] = ()) -> DataFrame:
    """The id column, those to ``keep``, and ids (binary: unsigned 32-bit integers, little-endian) and decoded, per row."""
    small_batches(docs.sparkSession)
    model = Model(tokenizer)
    content = compile_lexicon(frequent_words(docs, words, text), model)
    sent = docs.sparkSession.sparkContext.broadcast((model, content))       # bounded by the vocabulary and ``words``
    key = uuid.uuid4().hex
    names = [doc_id, *keep]
    rows = docs.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(names)], text_of(text).alias("text"))
    schema = rows.drop("text").schema.add("ids", "binary").add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(key, sent)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(start, ROWS_OUT)
                ids, decoded = codec.run_all(part.column(len(names)).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(names)], pa.array(ids, pa.binary()), decoded], names=schema.names)

    return rows.mapInArrow(run, schema).toDF(*names, "ids", "decoded")


def digests(encoded: DataFrame) -> DataFrame:
    kept = [quoted(c) for c in encoded.columns if c not in ("ids", "decoded")]
    return encoded.select(*kept, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                          F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op6_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(encode(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))
