"""Toxicity by a convolutional text classifier.

A word is lower-cased (A-Z), cut at white space, digits and ASCII punctuation, and hashed once; the two
halves of the hash pick a row each from two tables, and its embedding is the smaller of both in each
dimension, so a word that shares one row with a telling word is still told apart by the other. Filters of several widths slide over the words, each keeps its largest response in the
text, and a logistic layer weighs these. The network then scores whole texts in Spark tasks, whatever their length.

It is trained on all labelled rows outside the held-out remainder. Equal texts are one, with the mean of their labels. The
texts are dealt by their digests into shards of a bounded size; in a round each shard trains the network for one epoch
in a task of its own, and what the shards changed is averaged: by their texts, or, for a row of a table, over the shards that
touched it. With one shard that is plain training.

Thresholds are calibrated by language on a quarter of the texts, also chosen by digest, that the training leaves out: all of their
network outputs are counted in steps of 1/``STEPS``. The language is guessed from the letters of the text itself. A score is the logistic function of the
network's output less the threshold, so 0.5 divides the classes in every language.

Defined cases: a null text is empty and scores like a text without words; rows with equal ids stay
rows; a null id counts as the empty text for the held-out remainder; an id with several labels is toxic if
any is; a null label is no label; without labels of both classes every score is 0; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import deepcopy
from hashlib import md5
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlab.llm.common import documents, forget, quoted, small_batches, stored, text_of

SHARD_ROWS, SHARD_BYTES = 1 << 15, 1 << 27      # labelled rows and bytes of text of a shard, on average at most
COLLAPSED = 1 << 24         # bytes of texts among which copies are found before they are dealt
CHUNKS = 64                 # pieces in which what the shards found is added up
STEPS = 512
FOLDS = 5                   # remainder 0 is never learned from
BUCKETS = 1 << 16
DIM = 6
WIDTHS = (1, 2, 3)
FILTERS = 6                 # of each width
EPOCHS, BATCH, RATE, TABLE_RATE, DECAY = 6, 64, 0.01, 0.02, 1e-4
SMOOTH = 20.0
BLOCK_WORDS = 1 << 17       # words convolved at a time
# Letters that tell the languages apart.
LETTERS = {"de": "äöüß", "fr": "éèêàç", "es": "ñóíá"}
LANGUAGES = ("en", *LETTERS)
SPACE = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def word_hashes(text: str) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").translate(SPACE).split()
    return np.fromiter(map(crc32, words), np.uint32, len(words))


def language(text: str) -> int:
    """Place in LANGUAGES: the one with the most of its letters, else the first."""
    counts = [0] if text.isascii() else [0, *(sum(map(text.count, letters)) for letters in LETTERS.values())]
    return int(np.argmax(counts))


class Network:
    """Embeddings, filters and the logistic layer, with what Adam keeps of each."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.tables = rng.normal(0, 0.05, (2, BUCKETS + 1, DIM)).astype(np.float32)
        self.tables[:, BUCKETS] = 0                 # what stands between texts
        self.filters = [rng.normal(0, 0.4, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in self.filters:                      # to begin with, a window speaks by its first word's odds
            f[0] = np.abs(f[0]) + 0.5
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = np.full(len(WIDTHS) * FILTERS, 0.3, np.float32)
        self.level = np.float32(0)
        self.shift = np.zeros(len(LANGUAGES))
        self.squares = np.zeros((2, BUCKETS + 1), np.float32)
        self.moments = [np.zeros_like(p) for p in self.parameters() for _ in range(2)]
        self.steps = np.zeros(3)                    # steps taken, both moments of the level

    def parameters(self) -> list[np.ndarray]:
        return [*self.filters, self.bias, self.out]

    def embed(self, hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows of both tables for all words, padded behind each text, their embeddings, and where each text starts."""
        pad = max(WIDTHS) - 1
        sizes = np.array([max(1, len(h)) + pad for h in hashes])
        starts = np.r_[0, np.cumsum(sizes)]
        rows = np.full((2, starts[-1] + pad), BUCKETS, np.int64)
        for h, s in zip(hashes, starts):
            rows[0, s:s + len(h)] = h & 0xFFFF
            rows[1, s:s + len(h)] = h >> 16
        words = np.minimum(self.tables[0][rows[0]], self.tables[1][rows[1]])
        return rows[0], rows[1], words, starts

    def respond(self, words: np.ndarray, n: int) -> np.ndarray:
        """Responses of all filters where a window starts."""
        dim, parts, at = DIM, [], 0
        every = words @ np.concatenate([f[k * dim:(k + 1) * dim] for w, f in zip(WIDTHS, self.filters) for k in range(w)], axis=1)
        for w in WIDTHS:
            total = every[:n, at:at + FILTERS]
            for k in range(1, w):
                total = total + every[k:k + n, at + k * FILTERS:at + (k + 1) * FILTERS]
            parts.append(total)
            at += w * FILTERS
        return np.concatenate(parts, axis=1)

    def pooled(self, hashes: list[np.ndarray]) -> np.ndarray:
        """The largest responses per text, piece by piece where a text is long."""
        best = np.full((len(hashes), len(self.bias)), -np.inf, np.float32)
        pieces, size = [], 0

        def flush() -> None:
            _, _, words, starts = self.embed([h for _, h in pieces])
            found = np.maximum.reduceat(self.respond(words, starts[-1]), starts[:-1], axis=0)
            np.maximum.at(best, [i for i, _ in pieces], found)

        for i, h in enumerate(hashes):
            for at in range(0, max(1, len(h)), BLOCK_WORDS):
                piece = h[at:at + BLOCK_WORDS + max(WIDTHS) - 1]
                pieces.append((i, piece))
                size += len(piece) + 3
                if size >= BLOCK_WORDS:
                    flush()
                    pieces, size = [], 0
        if pieces:
            flush()
        return best

    def logits(self, hashes: list[np.ndarray]) -> np.ndarray:
        if not hashes:
            return np.zeros(0)
        return np.maximum(self.pooled(hashes) + self.bias, 0).astype(np.float64) @ self.out.astype(np.float64) + float(self.level)

    def start_from_odds(self, counts: np.ndarray, toxic: float, clean: float) -> None:
        """First column of both tables: smoothed log-odds of a text with the bucket being toxic; counts: by table, class and bucket."""
        base = np.log((toxic + 1) / (clean + 1))
        odds = np.log((counts[:, 1] + SMOOTH * np.exp(base)) / (counts[:, 0] + SMOOTH)) - base
        self.tables[:, :BUCKETS, 0] = np.clip(odds, -4, 4)

    def epoch(self, hashes: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, seed: list[int]) -> None:
        rng = np.random.default_rng(seed)
        moments, squares, dim = list(zip(self.moments[::2], self.moments[1::2])), self.squares, DIM
        step, level_m, level_v = self.steps
        order = rng.permutation(len(hashes))
        for at in range(0, len(order), BATCH):
            pick = order[at:at + BATCH]
            low, high, words, starts = self.embed([hashes[i] for i in pick])
            responses = self.respond(words, starts[-1])
            where = np.stack([s + responses[s:e].argmax(0) for s, e in zip(starts, starts[1:])])
            top = np.take_along_axis(responses, where, 0) + self.bias
            active = np.maximum(top, 0)
            p = 1 / (1 + np.exp(-(active @ self.out + self.level)))
            slope = ((p - labels[pick]) * weight[pick] / len(pick)).astype(np.float32)
            back = slope[:, None] * self.out * (top > 0)
            grads = [np.zeros_like(f) for f in self.filters]
            touched = np.zeros_like(words)
            for g, (w, f) in enumerate(zip(WIDTHS, self.filters)):
                own = slice(g * FILTERS, (g + 1) * FILTERS)
                for k in range(w):
                    place = where[:, own] + k
                    grads[g][k * dim:(k + 1) * dim] = np.einsum("nfd,nf->df", words[place], back[:, own])
                    np.add.at(touched, place, back[:, own, None] * f[k * dim:(k + 1) * dim].T[None])
            grads += [back.sum(0), active.T @ slope]
            step += 1
            for p_, g_, (m, v) in zip(self.parameters(), grads, moments):
                g_ = g_ + DECAY * p_
                m += 0.1 * (g_ - m)
                v += 0.001 * (g_ * g_ - v)
                p_ -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
            level_m += 0.1 * (slope.sum() - level_m)
            level_v += 0.001 * (slope.sum() ** 2 - level_v)
            self.level -= np.float32(RATE * (level_m / (1 - 0.9 ** step)) / (np.sqrt(level_v / (1 - 0.999 ** step)) + 1e-8))
            hit = np.flatnonzero(np.abs(touched).sum(1))
            hit = hit[low[hit] < BUCKETS]
            smaller = self.tables[0][low[hit]] <= self.tables[1][high[hit]]
            for t, r, g_ in ((0, low[hit], touched[hit] * smaller), (1, high[hit], touched[hit] * ~smaller)):
                np.add.at(squares[t], r, (g_ * g_).sum(1))
                np.subtract.at(self.tables[t], r, TABLE_RATE * g_ / (np.sqrt(squares[t][r]) + 1e-6)[:, None])
        self.steps = np.array([step, level_m, level_v])

    def dense(self) -> list[np.ndarray]:
        """What every text changes."""
        return [*self.parameters(), *self.moments, self.steps]

    def changes(self, before: Network, texts: int) -> np.ndarray:
        """The rows' changes of the tables and their squares, which rows were touched, the rest times the texts, and the texts."""
        dense = [np.asarray(x, np.float64).ravel() * texts for x in (*self.dense(), self.level)]
        tables, squares = self.tables - before.tables, self.squares - before.squares
        return np.concatenate([tables.ravel(), squares.ravel(), (tables != 0).any(2).ravel(), *dense, [texts]]).astype(np.float32)

    def take(self, total: np.ndarray) -> None:
        """Apply the sum of the changes of all shards."""
        t, q = self.tables.size, self.squares.size
        touched = np.maximum(1, total[t + q:t + 2 * q]).reshape(self.squares.shape)
        self.tables += (total[:t].reshape(self.tables.shape) / touched[..., None]).astype(np.float32)
        self.squares += (total[t:t + q].reshape(self.squares.shape) / touched).astype(np.float32)
        dense, at = total[t + 2 * q:-1] / total[-1], 0
        for x in self.dense():
            x[...] = dense[at:at + x.size].reshape(x.shape)
            at += x.size
        self.level = np.float32(dense[at])

    def calibrate(self, languages: np.ndarray, logits: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> None:
        """Per language the threshold of the fewest errors, each class weighed alike; of several the middle one.
        A language without both classes takes the threshold of all. Given are the texts of both classes per language and output."""
        everything = best_cut(logits, toxic, clean)
        for k in range(len(LANGUAGES)):
            own = languages == k
            enough = own.any() and min(toxic[own].sum(), clean[own].sum()) >= 5
            self.shift[k] = best_cut(logits[own], toxic[own], clean[own]) if enough else everything

    def scores(self, texts: list[str]) -> np.ndarray:
        shift = self.shift[[language(t) for t in texts]]
        return 1 / (1 + np.exp(-np.clip(self.logits([word_hashes(t) for t in texts]) - shift, -40, 40)))


def best_cut(logits: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    x, place = np.unique(logits, return_inverse=True)
    pos, neg = np.bincount(place, toxic), np.bincount(place, clean)
    missed = np.r_[0, np.cumsum(pos)] / max(1e-9, pos.sum()) + np.r_[np.cumsum(neg[::-1])[::-1], 0] / max(1e-9, neg.sum())
    edges = np.r_[x[:1] - 2, (x[1:] + x[:-1]) / 2, x[-1:] + 2]
    k = np.flatnonzero(missed <= missed.min() + 1e-9)
    widths = np.r_[0, np.diff(x), 0][k]
    return float(edges[k[np.argmax(widths)]])


def remainder(doc_id: str):
    return F.crc32(F.coalesce(quoted(doc_id).cast("string"), F.lit(""))) % FOLDS


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str) -> DataFrame:
    """shard, digest, held, lang, toxic (mean of the labels) and words (hashes) per distinct text of all labelled rows outside the
    held-out remainder; a partition holds whole shards, one behind the other, in the order of the digests."""
    marked = (labels.filter(quoted("toxic").isNotNull() & quoted(doc_id).isNotNull() & (remainder(doc_id) != 0))
              .groupBy(quoted(doc_id).alias("id")).agg((F.max(quoted("toxic")) > 0).cast("double").alias("toxic")))
    texts = docs.filter(quoted(doc_id).isNotNull() & (remainder(doc_id) != 0)).select(quoted(doc_id).alias("id"), text_of(text).alias("text"))
    size = texts.select("id", F.octet_length("text").alias("n")).join(marked, "id").agg(F.count("*"), F.sum("n")).first()
    shards = 1 + max(size[0] // SHARD_ROWS, (size[1] or 0) // SHARD_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            found = [x.as_py() for x in batch.column(1)]
            words = [word_hashes(x).tobytes() for x in found]
            lang = [language(x) for x in found]
            digests = [md5(w + bytes([k])).digest() for w, k in zip(words, lang)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests), pa.array(lang, pa.int32()), pa.array(words, pa.binary())], names=["id", "digest", "lang", "words"])

    hashed = texts.mapInArrow(run, texts.select("id").schema.add("digest", "binary").add("lang", "integer").add("words", "binary"))

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Copies that follow each other within a bounded number of bytes become one row."""
        kept, size = {}, 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*((d, *v) for d, v in kept.items()))) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.int64(), pa.float64(), pa.binary()))],
                                              names=["digest", "lang", "n", "toxic", "words"])

        for batch in batches:
            for digest, lang, toxic, words in zip(*(c.to_pylist() for c in batch.columns)):
                if digest in kept:
                    kept[digest][1] += 1
                    kept[digest][2] += toxic
                else:
                    kept[digest] = [lang, 1, toxic, words]
                    size += len(words) + 100
            if size >= COLLAPSED:
                yield flush()
                kept.clear()
                size = 0
        yield flush()

    known = hashed.join(marked.hint("merge"), "id").select("digest", "lang", "toxic", "words")      # texts are shuffled as hashes, once
    found = known.mapInArrow(collapse, "digest binary, lang int, n long, toxic double, words binary")
    key = F.xxhash64("digest")
    dealt = (found.withColumn("shard", F.pmod(F.shiftright(key, 2), F.lit(shards)).cast("int")).repartition(shards, "shard")
             .groupBy("shard", "digest").agg(F.first("lang").alias("lang"), (F.sum("toxic") / F.sum("n")).alias("toxic"), F.first("words").alias("words")))
    return stored(dealt.select("shard", "digest", (F.pmod(key, F.lit(4)) == 3).alias("held"), "lang", "toxic", "words")
                  .sortWithinPartitions("shard", "digest"))


def shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each shard in turn."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        for part in np.split(np.arange(len(shard)), np.flatnonzero(np.diff(shard)) + 1):
            if not len(part):
                continue
            if kept and kept[0].column("shard")[0].as_py() != shard[part[0]]:
                yield kept[0].column("shard")[0].as_py(), pa.Table.from_batches(kept)
                kept = []
            kept.append(batch.slice(part[0], len(part)))
    if kept:
        yield kept[0].column("shard")[0].as_py(), pa.Table.from_batches(kept)


def summed(rows: DataFrame, found) -> np.ndarray:
    """The sum over all shards of the arrays ``found(shard, word hashes, toxic)`` of one length."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for shard, table in shards_of(batches):
            words = [np.frombuffer(x.as_py(), np.uint32) for x in table["words"]]
            parts = np.array_split(found(shard, words, table["toxic"].to_numpy()), CHUNKS)
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([shard] * CHUNKS, pa.int32()),
                                              pa.array([x.tobytes() for x in parts], pa.binary())], names=["chunk", "shard", "body"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.float32).astype(np.float64) for x in table.sort_by("shard")["body"])
        return pa.table({"chunk": table["chunk"][:1], "body": pa.array([total.tobytes()], pa.binary())})

    parts = (rows.mapInArrow(pieces, "chunk int, shard int, body binary")
             .groupBy("chunk").applyInArrow(add, "chunk int, body binary").collect())       # the size of one network
    return np.concatenate([np.frombuffer(r["body"], np.float64) for r in sorted(parts, key=lambda r: r["chunk"])])


def bucket_counts(shard: int, words: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Texts by table, class and bucket."""
    counts = np.zeros((2, 2, BUCKETS), np.float32)
    for h, y in zip(words, toxic):
        for t, part in enumerate((h & 0xFFFF, h >> 16)):
            rows = np.unique(part)
            counts[t, 1, rows] += y
            counts[t, 0, rows] += 1 - y
    return counts.ravel()


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Network | None:
    """A network from all labelled rows outside the held-out remainder; None without both classes."""
    small_batches(docs.sparkSession)
    rows = labelled(docs, labels, doc_id, text)
    seen = {r["held"]: (r["toxic"], r["n"] - r["toxic"]) for r in rows.groupBy("held").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).collect()}
    toxic, clean = (sum(x[k] for x in seen.values()) for k in range(2))
    if min(toxic, clean) <= 0:
        return None
    fit, part = rows, rows
    if min(seen.get(False, (0, 0))) > 0:
        fit, (toxic, clean) = rows.filter("NOT held"), seen[False]
    if min(seen.get(True, (0, 0))) > 0:
        part = rows.filter("held")
    network = Network()
    network.start_from_odds(summed(fit, bucket_counts).reshape(2, 2, BUCKETS), toxic, clean)
    context = docs.sparkSession.sparkContext
    heavy, light = (toxic + clean) / (2 * toxic), (toxic + clean) / (2 * clean)
    for number in range(EPOCHS):
        sent = context.broadcast(network)           # a fixed size

        def trained(shard: int, words: list[np.ndarray], y: np.ndarray) -> np.ndarray:
            own = deepcopy(sent.value)
            own.epoch(words, y, y * heavy + (1 - y) * light, [11, number, shard])
            return own.changes(sent.value, len(y))

        network.take(summed(fit, trained))
    network.squares, network.moments = None, None
    sent = context.broadcast(network)

    def outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logits = sent.value.logits([np.frombuffer(x.as_py(), np.uint32) for x in batch.column("words")])
            at = np.rint(np.clip(logits, -40, 40) * STEPS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(at), batch.column("toxic")], names=["lang", "at", "toxic"])

    counts = (part.mapInArrow(outputs, "lang int, at int, toxic double").groupBy("lang", "at")
              .agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean")).toArrow())     # bounded by languages and steps
    network.calibrate(counts["lang"].to_numpy(), counts["at"].to_numpy() / STEPS, counts["toxic"].to_numpy(), counts["clean"].to_numpy())
    return network


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
          keep: list[str] | None = None) -> DataFrame:
    """The kept columns (the id alone, unless given) with held_out, score and predicted, per row."""
    keep = keep or [doc_id]
    network = learn(docs, labels, doc_id, text)
    sent = docs.sparkSession.sparkContext.broadcast(network)        # a fixed size
    whole = [*keep] if text in keep else [*keep, text]
    at = whole.index(text)
    wide = docs.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(whole)], (remainder(doc_id) == 0).alias("held_out"))
    kept = [f"c{i}" for i in range(len(keep))] + ["held_out"]
    schema = wide.select(*kept).schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        network = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                texts = [x.as_py() or "" for x in part.column(at)]
                found = network.scores(texts) if network else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*[part[c] for c in kept], pa.array(found, pa.float64()), pa.array((found >= 0.5).astype(np.int32))], names=schema.names)

    return wide.mapInArrow(run, schema).toDF(*keep, "held_out", "score", "predicted")


def clean(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that are not predicted toxic, with their own columns."""
    columns = list(docs.columns)
    scored = score(docs, labels, doc_id, text, keep=columns)
    names = [f"c{i}" for i in range(len(columns))]          # an input column may have the name of a result
    return scored.toDF(*names, "held_out", "score", "predicted").filter("predicted = 0").select(*names).toDF(*columns)


def op5_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
