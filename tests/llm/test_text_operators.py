"""Token files, fingerprints, BPE, licences, mixing: brute force, round trips and odd rows."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barlab.llm import bpe, licenses, mixing, simhash, tokenfile
from barlab.llm.common import shared_folder
from checks.compare import connect, difference

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
SPECS: dict = {}


@pytest.mark.parametrize("name", ["op4_exact_topk", "op7_license_scan", "op9_mix_sources"])
def test_query_equals_its_sql(spark, name):
    from barlab.llm.queries import ORACLE_SQL, QUERIES

    assert difference(name, spark, SF, QUERIES[name], ORACLE_SQL[name], connect(SF)) is None


# -- token files -------------------------------------------------------------------------------------------------


@given(st.lists(st.lists(st.integers(0, 70000), min_size=1, max_size=200), min_size=1, max_size=6))
@settings(max_examples=40, deadline=None)
def test_blocks_round_trip(blocks):
    arrays = [np.array(b, np.uint32) for b in blocks]
    assert [b.tolist() for b in tokenfile.read_blocks(tokenfile.code_blocks(arrays))] == blocks


def test_each_block_is_read_alone_and_damage_is_seen():
    blocks = [np.arange(500, dtype=np.uint32) % 37, np.full(9000, 5, np.uint32), np.array([0], np.uint32)]
    coded = tokenfile.code_blocks(blocks)
    assert tokenfile.read_blocks([coded[1]])[0].tolist() == blocks[1].tolist()
    assert len(coded[1]) < 9000 / 8
    with pytest.raises(ValueError):
        tokenfile.read_blocks([coded[0][:40] + bytes([coded[0][40] ^ 1]) + coded[0][41:]])


def test_blocks_of_a_table_are_smaller_than_deflated_ids():
    from tokenizers import Tokenizer

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()[:400]]
    ids = np.concatenate([np.array([*e.ids, tokenfile.END], np.uint32) for e in Tokenizer.from_file(BYTES).encode_batch(texts, add_special_tokens=False)])
    blocks = [ids[i:i + tokenfile.BLOCK] for i in range(0, len(ids), tokenfile.BLOCK)]
    coded = tokenfile.code_blocks(blocks)
    assert (np.concatenate(tokenfile.read_blocks(coded)) == ids).all()
    assert sum(map(len, coded)) < len(zlib.compress(ids.astype("<u2").tobytes(), 9))


def test_crc_of_joined_strings():
    a, b = b"first part" * 50, b"second" * 333
    assert tokenfile.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def files(spark, docs, monkeypatch=None):
    path = shared_folder(spark, "tokens-test")
    tokenfile.write(docs, path, BYTES)
    return sorted((tuple(r) for r in tokenfile.read_documents(spark, path).collect()), key=lambda r: r[1])


def wanted_files(rows):
    tok, at, out = Tokenizer.from_file(BYTES), 0, []
    for i, x in rows:
        ids = np.array([*tok.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


@given(st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "\t", "'s", "don't", "12", "é", "\u00a0", "\0", "...", "<|endoftext|>", "x y", "\u3000", "\r\n"]), max_size=14).map("".join))
@settings(max_examples=200, deadline=None)
def test_units_alone_equal_whole_texts(text):
    with open(BYTES, encoding="utf-8") as f:
        encoder = SPECS.setdefault("encoder", None) or SPECS.update(encoder=tokenfile.Encoder(f.read())) or SPECS["encoder"]
    want = encoder.library.encode(text, add_special_tokens=False).ids
    assert [ids_of(x) for x in encoder.ids([text, text + " the", text])] == [want, encoder.library.encode(text + " the", add_special_tokens=False).ids, want]


def test_a_unit_is_encoded_once_and_blocks_are_decoded_once(spark, real, monkeypatch):
    with open(BYTES, encoding="utf-8") as f:
        encoder = tokenfile.Encoder(f.read())
    asked = []
    monkeypatch.setattr(encoder, "encoded", lambda texts, of=encoder.encoded: asked.extend(texts) or of(texts))
    for _ in range(2):
        encoder.ids(["one two two\n two", "one two", ""])
    assert len(asked) == len(set(asked)) == 4
    path = shared_folder(spark, "tokens-once")
    tokenfile.write(real, path, BYTES)
    plan = tokenfile.read_documents(spark, path)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1        # that which joins the sums of a document in several blocks


def test_token_files_of_a_table(spark, real, real_texts):
    assert files(spark, real) == wanted_files(sorted(real_texts.items()))


def test_token_files_of_odd_rows(spark, odd, none):
    got = files(spark, odd)
    by_id = sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [g[0] for g in got] == [i for i, _ in by_id]
    strip = lambda rows: Counter((i, n, c) for i, _, n, c in rows)
    assert strip(got) == strip(wanted_files(by_id))
    assert [g[1] for g in got] == [sum(x[2] for x in got[:k]) for k in range(len(got))]
    assert files(spark, none) == []


# -- fingerprints ------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    values = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def plain_components(rows):
    """rows: (id, fingerprint); every pair is compared."""
    part = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, (_, a) in enumerate(rows):
            for j, (_, b) in enumerate(rows):
                if bin(a ^ b).count("1") <= 4 and part[i] != part[j]:
                    part[i] = part[j] = min(part[i], part[j])
                    changed = True
    names = {}
    for (i, _), p in zip(rows, part):
        names.setdefault(p, []).append(i)
    return {i: min(names[p]) for (i, _), p in zip(rows, part)}


def test_near_duplicates_of_a_table(spark, real, real_texts):
    got = {r.doc_id: r for r in simhash.near_duplicates(real).collect()}
    prints = [(i, plain_fingerprint(t)) for i, t in sorted(real_texts.items())]
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == dict(prints)
    assert {i: r.component_id for i, r in got.items()} == plain_components(prints)


def test_links_of_planted_fingerprints(spark):
    """Chains and dense groups of fingerprints, some beyond the reach of any group's ends."""
    rng = np.random.default_rng(3)
    values, center = set(), int(rng.integers(0, 1 << 63))
    for _ in range(60):
        values.add(center ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)))
    chain = int(rng.integers(0, 1 << 63))
    for k in range(8):
        values.add(chain)
        chain ^= sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
    values |= {int(v) for v in rng.integers(0, 1 << 63, 60)}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    from barlab.llm.components import components
    labels = {r.node: r.label for r in components(simhash.links(nodes)).collect()}
    want = plain_components([(s, v) for s, v in zip(signed, values)])
    assert {v: labels.get(v, v) for v in signed} == want


def test_links_of_a_dense_group_grow_with_its_members(spark):
    """A group in which every member has many links: a few of them per member connect it, first shared keys give each pair once."""
    rng = np.random.default_rng(8)
    center = int(rng.integers(0, 1 << 63))
    values = sorted({center ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(3, 7), replace=False)) for _ in range(700)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    from barlab.llm.components import components
    found = simhash.links(nodes).persist()
    labels = {r.node: r.label for r in components(found).collect()}
    assert {v: labels.get(v, v) for v in signed} == plain_components(list(zip(signed, values)))
    assert found.count() <= 3 * len(values)
    pairs = spark.createDataFrame([(a, b) for a, b in zip(signed[:400], signed[1:401])], "a long, b long").select("a", "b", simhash.first_shared().alias("k"))
    for r in pairs.collect():
        x = (r.a ^ r.b) & ((1 << 64) - 1)
        shared = [sum(n for _, n in simhash.SEGMENTS[:i]) + j for i, (first, n) in enumerate(simhash.SEGMENTS) for j in range(n)
                  if (x >> first) & ((1 << n) - 1) & ~(1 << j) == 0]
        assert r.k == min(shared, default=-1)


def test_few_links_take_few_jobs(spark, monkeypatch):
    from barlab.llm import components
    order = np.random.default_rng(4).permutation(3000).tolist()
    edges = spark.createDataFrame([*zip(order[:1999], order[1:2000]), *zip(order[2000:], order[2001:]), (7, 7), (order[0], order[1])], "a long, b long")
    want = {v: min(g) for g in (order[:2000], order[2000:]) for v in g}
    spark.sparkContext.setJobGroup("few links", "few links")
    try:
        got = {r.node: r.label for r in components.components(edges).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == want and len(spark.sparkContext.statusTracker().getJobIdsForGroup("few links")) <= 8
    monkeypatch.setattr(components, "FEW", 100)         # rounds over all tasks, then the rest
    assert {r.node: r.label for r in components.components(edges).collect()} == want
    assert components.components(edges.limit(0)).count() == 0


def test_keys_of_fingerprints_are_written_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SPREAD", 10)
    parts = spark.range(95).selectExpr("id * 7919 AS fp", "id AS part").coalesce(1)
    plan = simhash.crowded(parts)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [fp" in plan and ", 10" in plan.split("RepartitionByExpression", 1)[1].splitlines()[0]


def test_rows_of_keys_are_never_broadcast(spark):
    """Spark sizes an explode by its input: few fingerprints under all their keys would be sent to the driver whole."""
    parts = spark.range(20000).select(F.xxhash64("id").alias("fp"), F.col("id").alias("part")).localCheckpoint()
    for found in (simhash.stars(parts.select("fp")), simhash.crowded(parts)):
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_other_tasks_drop_what_the_codec_remembers(real, monkeypatch):
    """Python workers outlive a query: the codec of one stage is not held through the next."""
    from barlab.llm import toxicity
    taken = []

    def take(self, run, *rest):
        taken.append(run)
        raise LookupError

    monkeypatch.setattr(type(real), "mapInArrow", take)
    for build in (lambda: simhash.fingerprints(real), lambda: toxicity.summed(real, None)):
        with pytest.raises(LookupError):
            build()
        bpe.LAST_CODEC[:] = [("key", None)]
        assert list(taken.pop()(iter([]))) == [] and not bpe.LAST_CODEC


def test_near_duplicates_of_odd_rows(spark, odd, none):
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd).collect())
    zero = "0" * 16
    assert got[(3, zero, 3)] == 1 and got[(4, zero, 3)] == 2 and got[(5, zero, 3)] == 1
    assert sum(got.values()) == odd.count() and len({c for i, _, c in got if i in (1, 2)}) == 1
    kept = Counter(r.doc_id for r in simhash.keep_first(odd).collect())
    assert kept[1] == 1 and kept[2] == 0 and kept[3] == 1 and kept[4] == 0 and kept[7] == 1 and kept[None] == 1
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_first(none).columns == none.columns


# -- BPE ---------------------------------------------------------------------------------------------------------

ODD_TEXTS = ["", " ", "Σίσυφος ΟΔΟΣ", "İstanbul ı", "a\x1cb\x1f c", "é Éà", "<|startoftext|>hi<|endoftext|> <|x|>", "don't they'll I'M 's",
             "１２３ ²½ Ⅷ", "x" * 3000, "thetion" * 100, "日本語 テキスト", "a b\u0085c", "ﬁ ǅ ß ẞ", "_foo_bar__ 12345 $$$", "👍🏽 👩‍👩‍👧", "a\0b",
             "<|endoftext|><|endoftext|>", "the the "]


@pytest.fixture(scope="module")
def model():
    return bpe.Model(WORDS)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


@pytest.mark.parametrize("words", [[], [b"the", b"then", b"th", "é".encode(), b"don", b"s"]])
def test_codec_equals_the_library(model, library, words):
    codec = bpe.Codec(model, bpe.Lexicon(bpe.compile_lexicon(words, model)))
    for text in ODD_TEXTS:
        raw, decoded = codec.run(text)
        ids = library.encode(text, add_special_tokens=False).ids
        assert ids_of(raw) == ids and decoded == library.decode(ids, skip_special_tokens=False), text


@given(st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=60))
@settings(max_examples=150, deadline=None)
def test_codec_on_any_text(model, library, text):
    codec = bpe.Codec(model, bpe.Lexicon(bpe.compile_lexicon([b"a", b"the"], model)))
    assert ids_of(codec.run(text)[0]) == library.encode(text, add_special_tokens=False).ids


@given(st.sets(st.binary(min_size=1, max_size=8), max_size=40))
@settings(max_examples=60, deadline=None)
def test_lexicon_holds_its_words_and_no_others(model, words):
    lexicon = bpe.Lexicon(bpe.compile_lexicon(list(words), model))
    assert all(list(lexicon.get(w)) == model.merge(w) for w in words)
    assert all(lexicon.get(w + b"q") is None for w in words if w + b"q" not in words)


def test_long_words_merge_alike(model):
    word = b"internationalization" * 9
    ids = [model.inner[b] for b in word[:-1]] + [model.last[word[-1]]]
    assert model.merge_long(list(ids)) == model.merge(word)


@given(st.lists(st.binary(min_size=1, max_size=60), min_size=1, max_size=40))
@settings(max_examples=60, deadline=None)
def test_words_side_by_side_equal_words_alone(model, words):
    words += [b"internationalization", b"thetionthetion", b"a", b"e" * 80]
    assert bpe.Merger(model).merge(words) == [np.array(model.merge(w), "<u4").tobytes() for w in words]
    lexicon = bpe.Lexicon(bpe.compile_lexicon(words[::2], model))
    assert lexicon.find(words) == [None if (ids := lexicon.get(w)) is None else ids.tobytes() for w in words]


def test_texts_together_equal_texts_alone(model, library, monkeypatch):
    """Chunks that are forgotten between two batches, and those that come twice in one, have the same ids."""
    monkeypatch.setattr(bpe, "CHUNKS_KEPT", 4)
    monkeypatch.setattr(bpe, "WORDS_KEPT", 3)
    codec = bpe.Codec(model, bpe.Lexicon(bpe.compile_lexicon([b"the", b"don"], model)))
    for texts in (ODD_TEXTS, ODD_TEXTS[::-1], [], ODD_TEXTS + ODD_TEXTS):
        ids, decoded = codec.run_all(texts)
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert [ids_of(raw) for raw in ids] == want and decoded.to_pylist() == [library.decode(w, skip_special_tokens=False) for w in want]


def test_codec_remembers_little(model):
    """What a worker holds for words it has seen stays small: an encoder runs in every worker of an executor."""
    rng = random.Random(3)
    codec = bpe.Codec(model, bpe.Lexicon(bpe.compile_lexicon([b"the"], model)))
    tracemalloc.start()
    for _ in range(8):
        codec.run_all([" ".join("".join(rng.choices("abcdefgh", k=9)) for _ in range(50_000))])
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 110 << 20


def test_texts_go_to_python_in_small_batches(spark, real):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(key)
    simhash.fingerprints(real)
    assert spark.conf.get(key) == "1024"
    spark.conf.set(key, "77")
    simhash.fingerprints(real)
    assert spark.conf.get(key) == "77"
    spark.conf.unset(key)


def test_suffixes_are_shared(model):
    words = [a + b"tionality" for a in (b"na", b"ra", b"emo", b"fic")]
    alone = [len(bpe.compile_lexicon([w], model)) for w in words]
    assert len(bpe.compile_lexicon(words, model)) < 0.6 * sum(alone)


def test_encoding_of_tables(spark, real, real_texts, odd, none, library):
    got = {r.doc_id: r for r in bpe.digests(bpe.encode(real, WORDS)).collect()}
    for i, t in real_texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    rows = bpe.encode(odd, WORDS).collect()
    want = Counter((r.doc_id, tuple(library.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect())
    assert Counter((r.doc_id, tuple(ids_of(r.ids))) for r in rows) == want
    assert bpe.encode(none, WORDS).count() == 0


def test_frequent_words(spark):
    docs = spark.createDataFrame([("a a a b b c",), ("a b d,",), (None,)], "text string")
    assert sorted(bpe.frequent_words(docs, 2)) == [b"a", b"b"] and bpe.frequent_words(docs, 1) == [b"a"]


# -- licences ----------------------------------------------------------------------------------------------------


def plain_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
    places = sorted(i for i, _ in found)
    return len(words), len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted({b for _, b in found}))


def test_licences_of_odd_rows(odd, none):
    rows = licenses.scan(odd).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows) == \
        Counter((r.doc_id, *plain_scan(r.text)) for r in odd.collect())
    nine = next(r for r in rows if r.doc_id == 9)
    assert nine.base_labels == "apache-2,cc-by-nc,mit" and nine.score == 1.0
    assert licenses.scan(none).count() == 0


def test_blocks_meet_templates_without_base_phrases(spark):
    text = ("filler " * 50 + "redistribution and use, in source and binary forms with or without modification, is permitted "
            "provided that these following conditions are met" + " filler" * 50)
    docs = spark.createDataFrame([(1, text), (2, "redistribution of source " * 30), (3, "the license of the work " * 40)], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.base_labels) for r in licenses.scan(docs, threshold=0.85).collect()}
    assert got == {1: ("bsd", ""), 2: ("", ""), 3: ("", "")}


# -- mixing ------------------------------------------------------------------------------------------------------


def test_mixing_reaches_its_targets(spark):
    docs = spark.createDataFrame([(i, "x" * 50, "a" if i % 3 else "b") for i in range(6000)], "doc_id long, text string, source string")
    out = mixing.mix(docs, {"a": 0.3}, total=1.5).collect()
    mass = Counter(r.source for r in out)
    assert abs(mass["a"] / 9000 - 0.3) < 0.02 and abs(len(out) / 9000 - 1) < 0.03
    assert all(r.copy <= r.n_copies for r in out) and len({(r.doc_id, r.copy) for r in out}) == len(out)
    again = mixing.mix(docs, {"a": 0.3}, total=1.5).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


def test_mixing_with_large_rates(spark):
    docs = spark.createDataFrame([(0, "x", "a"), (1, "y" * 999, "b")], "doc_id long, text string, source string")
    n = mixing.mix(docs, {"a": 0.6}).filter("source = 'a'").count()
    assert 450 < n < 750


def test_mixing_of_odd_rows(odd, none):
    out = mixing.mix(odd, {"src0": 0.5}, total=3.0)
    assert out.columns == [c for c in odd.columns if c != "copy"] + ["n_copies", "copy", "shuffle_key"]
    rows = out.collect()
    counts = {(r.doc_id, r.text): r.n_copies for r in rows}
    assert Counter((r.doc_id, r.text) for r in rows) == {k: n * (2 if k == (4, "") else 1) for k, n in counts.items()}
    assert mixing.mix(none).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(odd, {"a": 0.7, "b": 0.6})
