"""Operators on single texts and pages."""

import hashlib
import random
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace
from xml.etree import ElementTree

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyspark.llm import bpe, html_text, langid, ngram_join, packing, queries, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def odd_texts():
    rng = random.Random(1)
    letters = "a b'sStrevemlld  \n\t\r\x1c\x85\xa0　 éß漢字🙂0123½١.,!?-_\"<|endoftext|>"
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    out += ["".join(chr(rng.choice([rng.randint(32, 0x2FFF), rng.randint(0x3000, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(30)) for _ in range(500)]
    return [*out, "", "<|endoftext|>", "a<|endoftext|>b <|endoftext|><|endoftext|> c", "<|endof", "text|>", "x" * 3_000_000, "ab'" * 3000, "\n \n  x", "  ", "don't you'll we've I'd I'm", "ab " * 700_000]


def test_fragments_encode_as_the_library_does(library):
    texts = odd_texts()
    encoder = bpe.FragmentEncoder(open(PATH, encoding="utf-8").read(), keep_bytes=200_000)
    for text, ids in zip(texts, encoder.encode(t.encode() for t in texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, text[:80]
        assert encoder.vocabulary.text(ids).decode("utf-8", "replace") == library.decode(want, skip_special_tokens=False)


def test_encoding_query(spark, sf_dir, library):
    docs = {r[0]: r[1] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op6_bpe(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def test_partial_letters_decode_to_replacement_marks(spark, library):
    ids = library.encode("漢", add_special_tokens=False).ids[:1]
    got = bpe.decode(spark.createDataFrame([(1, ids), (2, []), (3, None)], "doc_id bigint, token_ids array<int>"), PATH).orderBy("doc_id").collect()
    assert [r["decoded"] for r in got] == [library.decode(ids, skip_special_tokens=False), "", ""]


def check_packing(pieces, ids, capacity):
    """Each id in exactly one piece, pieces gapless in their sequences, and little room left."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc, rows in by_doc.items():
        at = 0
        for r in sorted(rows, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids[doc]))
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[doc][r["start"] : at], "<u4").tobytes())
        assert at == len(ids[doc])
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= capacity
    return by_sequence


def thue_morse(first, second, doublings):
    """Two words of which polynomial hashes modulo a power of two are equal."""
    for _ in range(doublings):
        first, second = first + second, second + first
    return first, second


def test_fragments_are_told_apart_by_their_bytes(library):
    encoder = bpe.FragmentEncoder(open(PATH, encoding="utf-8").read())
    words = [w for k in (11, 12) for w in thue_morse("a", "b", k)]
    assert [list(x) for x in encoder.encode([w.encode() for w in words])] == [library.encode(w).ids for w in words]


def test_remembered_fragments_are_told_apart_by_their_bytes(library, monkeypatch):
    """Blocks of one text, and hashes that only know a fragment's size."""
    monkeypatch.setattr(bpe, "hashed", lambda data, start, size: size.astype(np.uint64) << np.uint64(40))
    encoder = bpe.FragmentEncoder(open(PATH, encoding="utf-8").read(), block_bytes=1)
    words = ["hound", "horse", "hound", "a longer one, of two parts", "another on, of the size 26", "x" * 60, "y" * 60, "horse"]
    for _ in range(2):
        assert [list(x) for x in encoder.encode([w.encode() for w in words])] == [library.encode(w).ids for w in words]


def test_a_worker_remembers_many_fragments(library):
    """400,000 words, once known, do not reach the merging encoder again."""
    encoder = bpe.FragmentEncoder(open(PATH, encoding="utf-8").read())
    parts = ["er", "en", "in", "st", "te", "re", "an", "on", "is", "al", "or", "it", "at", "es", "ar", "le"]
    texts = [" ".join("".join(parts[n >> 4 * i & 15] for i in range(5)) for n in range(k, k + 1000)).encode() for k in range(0, 400_000, 1000)]
    first = [x.tolist() for x in encoder.encode(texts)]
    merged, library_ = [], encoder.merger
    encoder.merger = SimpleNamespace(encode_batch_fast=lambda some, **kw: merged.extend(some) or library_.encode_batch_fast(some, **kw))
    assert [x.tolist() for x in encoder.encode(texts)] == first
    assert len(merged) < 1000
    assert first[7] == library.encode(texts[7].decode()).ids


def test_words_with_equal_polynomials_do_not_link(spark):
    one, two = thue_morse("a", "b", 12)
    rows = [(1, one), (2, two), (3, f"{one} " * 7), (4, f"{two} " * 7), (5, one)]
    found = ngram_join.join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 1)]


def test_packing_query(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in docs}
    pieces = queries.op1_pack(spark, sf_dir).collect()
    sequences = check_packing(pieces, ids, 1024)
    assert set(ids) == {r["doc_id"] for r in pieces}
    total = sum(map(len, ids.values()))
    assert len(sequences) * 1024 - total < 4 * 1024 + 0.01 * total


def test_packing_balances_cost():
    rng = random.Random(5)
    pieces = [packing.Piece(rng.randint(1, 1000), n, n, 0, 0, b"") for n in range(4000)]
    sequences, left = packing.balanced(pieces, -(-sum(p.length for p in pieces) // 1024), 1024, 1.0, 1 / 1024)
    assert not left
    sizes = [sum(p.length for p in s) for s in sequences]
    assert sum(sizes) == sum(p.length for p in pieces) and max(sizes) <= 1024 and len(sizes) == -(-sum(sizes) // 1024)
    cost = [sum(p.length + p.length**2 / 1024 for p in s) for s in sequences]
    assert np.std(cost) < 0.25 * np.mean(cost)


def test_packing_many_short_documents(spark):
    """Work and what a task holds stay in proportion, however short the documents are."""
    rng = random.Random(6)
    docs = spark.createDataFrame([(n, "a b " * rng.randint(0, 3)) for n in range(200_000)], "doc_id bigint, text string").coalesce(4)
    began = time.time()
    rows = packing.pack(docs, PATH, with_ids=False).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.collect_list("doc_id").alias("ids")).collect()
    assert time.time() - began < 60
    assert {i for r in rows for i in r["ids"]} == set(range(200_000))
    assert sum(1024 - r["n"] for r in rows) < 4 * 1024 and max(r["n"] for r in rows) == 1024


def test_packing_gives_out_few_rows_at_once(spark, monkeypatch):
    frame = spark.createDataFrame([], "doc_id bigint, text string")
    tasks = []
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, run, schema: tasks.append(run))
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    packing.pack(frame, PATH)
    batch = pa.RecordBatch.from_arrays([pa.array(range(6000), pa.int64()), pa.array(["one two"] * 5999 + ["a b " * 800_000])], ["doc_id", "text"])
    out = list(tasks[0](iter([batch])))
    assert sum(b.num_rows for b in out) >= 6000 + 1500
    # a sequence of many short documents is given out whole
    assert sum(b.num_rows > 1024 + 512 for b in out) == 0


def test_packing_odd_rows(spark, library):
    rows = [(1, None), (2, ""), (3, "word " * 5000), (3, "word " * 5000), (None, "x"), (4, "y")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as start", "2 as sequence_id", "3 as token_ids")
    out = packing.pack(frame, PATH, batch_docs=2)
    got = out.collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in got if (r["doc_id"] or 0) in (0, 1, 2)) == [(0, 2), (1, 1), (2, 1)]
    assert sum(r["length"] for r in got if r["doc_id"] == 3) == 2 * (len(library.encode("word " * 5000).ids) + 1)
    assert all(len(r["token_ids"]) == r["length"] for r in got)
    assert packing.pack(frame.limit(0), PATH).collect() == []


def test_language_query_on_held_out_texts(spark):
    sf_dir = "/root/testdata/sf0.01"
    truth = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect())
    got = queries.op3_langid(spark, sf_dir).collect()
    assert len(got) == len(truth) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)


def test_language_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "en"), (4, "", None), (5, "123 !?", "en"), (6, "a", None), (6, "a", None), (7, "漢字 " * 50_000, None), (8, "the dog", None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "1 as score", "'x' as lang_pred", "2 as total")
    prototypes = langid.train(frame)
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.identify(frame, prototypes).orderBy("doc_id").collect()]
    assert set(prototypes) == {"en", "fr"} and len(got) == 9
    assert [x for x in got if x[0] in (1, 2, 3, 4, 5, 8)] == [(1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "und"), (8, "en")]
    assert langid.train(frame.limit(0)) == {}
    assert {r["lang_pred"] for r in langid.identify(frame, {}).collect()} == {"und"}
    assert langid.identify(frame.limit(0), prototypes).collect() == []


def test_profiles_bind_rotated_letters():
    p = langid.Profiler(64, 3, 17)
    (_, got), *_ = p.blocks(["ab"])
    a, b, gap = (p.vector(c).astype(float) for c in (ord("a"), ord("b"), 32))
    want = np.roll(gap, 2) * np.roll(a, 1) * b + np.roll(a, 2) * np.roll(b, 1) * gap
    assert np.allclose(got[0], want / np.linalg.norm(want), atol=1e-6)


def profile_by_hand(text, dims, n, seed):
    """The sum of the bound vectors of a text's n-grams, one after another; None without a letter."""
    letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    if not letters.strip():
        return None
    letters = " " + " ".join(letters.split()) + " "
    letters = letters.ljust(n)
    vector = lambda c: 2 * np.random.Generator(np.random.PCG64([seed, ord(c)])).integers(0, 2, dims) - 1
    total = np.zeros(dims)
    for i in range(len(letters) - n + 1):
        bound = np.ones(dims)
        for k, c in enumerate(letters[i : i + n]):
            bound *= np.roll(vector(c), n - 1 - k)
        total += bound
    return total / np.linalg.norm(total)


def test_language_profiles_by_hand(spark):
    rng = random.Random(9)
    rows = [(n, "".join(rng.choice(("abcdef g", "éßxyz .", "漢字かな、")[n % 3]) for _ in range(rng.randint(1, 60))), ("a", "b", "c")[n % 3]) for n in range(60)]
    rows += [(60, None, "a"), (61, "12 .", "b"), (62, "a", None), (62, "zz9é", None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    profiles = [profile_by_hand(t, 128, 3, 17) for _, t, _ in rows]
    sums = {x: np.sum([p for p, (*_, lang) in zip(profiles, rows, strict=True) if lang == x and p is not None], 0) for x in "abc"}
    prototypes = langid.train(frame, dims=128)
    want = []
    for (i, *_), p in zip(rows, profiles, strict=True):
        cosine = {x: float(p @ v / np.linalg.norm(v)) for x, v in sums.items()} if p is not None else {"und": 0.0}
        best = max(sorted(cosine), key=cosine.get)
        want.append((i, best, cosine[best]))
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(frame, prototypes).collect()]
    assert [r[:2] for r in sorted(got)] == [r[:2] for r in sorted(want)]
    assert np.allclose([r[2] for r in sorted(got)], [max(0.0, r[2]) for r in sorted(want)], atol=1e-5)
    # a small table of counts, columns in parts
    parts = [q for _, some in langid.Profiler(128, 3, 17, block_chars=200, cells=50).blocks([t for _, t, _ in rows]) for q in some]
    assert np.allclose(parts, [p for p in profiles if p is not None], atol=1e-5)


def test_toxicity_query_on_held_out_texts(spark):
    sf_dir = "/root/testdata/sf0.1"
    truth = dict(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").collect())
    got = queries.op9_toxicity(spark, sf_dir).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    hits = sum(r["predicted"] and truth[r["doc_id"]] for r in held)
    assert hits >= 0.9 * sum(r["predicted"] for r in held)
    assert hits >= 0.88 * sum(truth[r["doc_id"]] for r in held)


def test_toxicity_odd_rows(spark):
    good, bad = "a nice day for a walk", "you utter zorgon go away"
    rows = [(n, bad if n % 3 == 0 else good) for n in range(60)] + [(100, None), (101, ""), (102, "!!"), (103, "zorgon " * 30_000), (103, good), (None, good)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as score", "2 as label", "3 as toxic", "4 as word")
    labels = spark.createDataFrame([(n, int(n % 3 == 0)) for n in range(60)] + [(100, 1), (None, 1), (5, None), (6, 7), (999, 1)], "doc_id bigint, toxic int").selectExpr("*", "'x' as text")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r["predicted"] for r in got}
    assert by_id[3] == 1 and by_id[4] == by_id[100] == by_id[101] == by_id[102] == 0
    assert toxicity.score(docs.limit(0), model).collect() == []
    empty = toxicity.train(docs, labels.limit(0))
    assert {r["predicted"] for r in toxicity.score(docs, empty).collect()} == {0}


def test_repeating_a_text_leaves_its_evidence():
    counts = [defaultdict(int), defaultdict(int)]
    for k, words in enumerate(("a nice day for a walk in the park with a dog", "a bad day for you utter zorgon go away with a dog")):
        for w in words.split():
            for g in toxicity.grams(w, 4):
                counts[k][g] += 3
    for growth in (0.0, 0.4):
        reader = toxicity.Reader(model_of(counts, 4), 4, 12, 2, growth)
        check_repeats(reader)


def check_repeats(reader):
    for text in ("nice", "a nice walk ", "a bad day for a walk ", "you utter zorgon ", "the park with a dog "):
        assert np.isclose(reader.evidence((text + " ") * 1000), reader.evidence(text))
    assert reader.evidence("a nice walk with you utter zorgon") > reader.evidence("a nice walk with a dog " * 1000)


def model_of(counts, order, discount=0.75):
    """The operator's model from two counts of expressions."""
    names = sorted({*counts[0], *counts[1]})
    return toxicity.kneser_ney("".join(names), np.array([[c.get(g, 0) for c in counts] for g in names]), order, discount)


def evidence_by_hand(text, ratios, order, piece, window, most=1.0):
    """Every expression looked up in the model by itself, every window summed by itself."""
    values = []
    for run in toxicity.runs(text):
        each = [next((ratios[g[k:]] for k in range(order) if g[k:] in ratios), 0.0) for g in toxicity.grams(run, order)]
        each = [*each[:-2], each[-2] + each[-1]]
        values += [sum(each[i : i + piece]) for i in range(0, len(each), piece)]
    if not values:
        return 0.0
    level = min(float(np.median(values)), most)
    ring = [values[(i + k) % len(values)] - level for i in range(len(values)) for k in range(window)]
    return max(sum(ring[i : i + window]) / window for i in range(0, len(ring), window))


def backoff_by_hand(gram, shared, discount):
    """Kneser-Ney of a letter after others in both classes, by its definition; ``shared``: counts, longest expressions first."""
    both = [n for g, n in shared[0].items() if g[:-1] == gram[:-1]]
    lower = backoff_by_hand(gram[1:], shared[1:], discount) if len(gram) > 1 else 1 / (len(shared[0]) + 1)
    return max(shared[0].get(gram, 0) - discount, 0) / sum(both) + discount * len(both) / sum(both) * lower


def probability_by_hand(gram, own, shared, discount):
    """The same in one class, which backs off to what both share."""
    context, back = [n for g, n in own.items() if g[:-1] == gram[:-1]], backoff_by_hand(gram, shared, discount)
    if not context:
        return back
    return max(own.get(gram, 0) - discount, 0) / sum(context) + discount * len(context) / sum(context) * back


def test_rare_expressions_leave_the_table_after_all_are_counted():
    """The table without them has the very ratios of a model of all, so shorter expressions count what is left out."""
    rng, counts = random.Random(8), [defaultdict(int), defaultdict(int)]
    for k in range(2):
        for _ in range(300):
            for g in toxicity.grams("".join(rng.choice("abcdefghijk") for _ in range(rng.randint(1, 9))), 4):
                counts[k][g] += 1
    names = sorted({*counts[0], *counts[1]})
    both = np.array([[c.get(g, 0) for c in counts] for g in names])
    often = toxicity.kneser_ney("".join(names), both, 4, 0.75, 4)
    found = Counter(g[k:] for g, n in zip(names, both.sum(1).tolist(), strict=True) for k in range(4) for _ in range(n))
    assert set(often[0].tolist()) == {toxicity.key(g) for g, n in found.items() if n >= 4} and len(often[0]) < len(found)


def test_toxicity_model_and_evidence_by_hand():
    rng = random.Random(12)
    order, counts = 4, [defaultdict(int), defaultdict(int)]
    for k in range(2):
        for _ in range(80):
            for g in toxicity.grams("".join(rng.choice("abcé") for _ in range(rng.randint(1, 30))), order):
                counts[k][g] += 1
    model = model_of(counts, order)
    names = {g[k:] for c in counts for g in c for k in range(order)}
    ratios = {g: model[1][np.searchsorted(model[0], np.uint64(toxicity.key(g)))] for g in names}
    assert set(model[0].tolist()) == set(map(toxicity.key, names))
    levels = [[dict(c)] for c in counts]
    for _ in range(order - 1):
        for own in levels:
            own.append(dict(Counter(g[1:] for g in own[-1])))
    shared = [dict(Counter(a) + Counter(b)) for a, b in zip(*levels, strict=True)]
    for g in rng.sample(sorted(ratios), 200):
        depth = order - len(g)
        p = [probability_by_hand(g, own[depth], shared[depth:], 0.75) for own in levels]
        assert np.isclose(ratios[g], np.log(p[1] / p[0])), g
    texts = ["".join(rng.choice("abcéÉ x9 .") for _ in range(rng.randint(0, 300))) for _ in range(300)] + [None, "", "9.", "a" * 5000]
    for block_chars in (100, 500_000):
        got = list(toxicity.Reader(model, order, 12, 2, block_chars=block_chars).all(texts))
        assert np.allclose(got, [evidence_by_hand(t, ratios, order, 12, 2) for t in texts])
        long = [w for _, w in toxicity.Reader(model, order, 12, 2, block_chars=block_chars).largest(texts)]
        less = toxicity.Reader(model, order, 12, 2, 0.3, 1.5, block_chars=block_chars).all(texts)
        assert np.allclose(list(less), np.array(got) - 0.3 * np.maximum(0, np.array(long) - 1.5)) and max(long) > 3 and long[-4:-1] == [0, 0, 0] and long[-1] < 1.5


def test_growth_is_that_of_ordinary_texts():
    length = np.log(np.arange(8, 400.0))
    growth, usual = toxicity.growth_of(1 + 0.25 * length, length, np.ones(len(length)))
    assert np.isclose(growth, 0.5) and np.isclose(usual, np.percentile(length, 25))
    assert toxicity.growth_of(3 - length, length, np.ones(len(length)))[0] == 0 == toxicity.growth_of(length[:20], length[:20], np.ones(20))[0]


@pytest.mark.parametrize("lang", ["en", "de", "fr", "es"])
def test_long_clean_texts_are_not_marked_for_their_length(toxicity_at_sf01, lang):
    """Held-out texts with label 0, of one language: 1, 20 or 60 of them joined."""
    model, held = toxicity_at_sf01
    reader, rng = toxicity.Reader(*model[:6]), random.Random(5)
    for k, draws in ((1, 150), (20, 80), (60, 30)):
        texts = [" ".join(rng.choices(held[lang], k=k)) for _ in range(draws)]
        marked = sum(x >= model.place for x in reader.all(texts))
        assert marked <= 0.06 * draws if k == 1 else marked <= 0.03 * draws, (k, marked)


@pytest.fixture(scope="session")
def toxicity_at_sf01(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.where(queries.fold(4) != 2))
    held = defaultdict(list)
    for r in docs.join(labels.where((queries.fold(4) == 2) & (F.col("toxic") == 0)), "doc_id").where("text is not null").select("lang", "text").collect():
        held[r["lang"]].append(r["text"])
    return model, held


def test_toxicity_reads_every_letter(spark):
    rng = random.Random(3)

    words = ["".join(rng.choice("bdfghklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 3))) for _ in range(60)]
    signs = ["".join(chr(0x4E00 + rng.randint(0, 200)) for _ in range(3)) for _ in range(60)]

    def text(n, bad):
        """Words, or runs of 12 signs; what marks a text stands behind a word of its own, or behind 6 signs."""
        if n % 2:
            held = rng.choices(words, k=30)
            held[rng.randrange(30)] += "zorgon" * bad + rng.choice(words)
        else:
            held = ["".join(rng.choices(signs, k=4)) for _ in range(8)]
            at = rng.randrange(8)
            held[at] = held[at][:6] + "龍龜鳳" * bad + held[at][6:]
        return " ".join(held)

    rows = [(n, text(n, n % 10 < 3)) for n in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(n, int(n % 10 < 3)) for n in range(600)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect() if r["doc_id"] >= 600}
    hits = sum(p for n, p in got.items() if n % 10 < 3)
    # nearly all that is marked; in a sample this small also some of the rest
    assert hits >= 0.9 * 180 and sum(got.values()) - hits <= 420 / 3


PAGES = {
    "": "",
    "plain words": "plain words",
    "<div>hello <b>x</b>y<br>z</div>": "hello xy z",
    "<p>one<p>two": "one\ntwo",
    "<body><nav>menu</nav><article><h1>T</h1><p>a &amp; b&nbsp;c</p></article><aside>s</aside><footer>f</footer>": "T\na & b c",
    "<body><div class='cookie-notice'>we use</div><div id=main><p>text of it</p><form>f<p>g</p></form><p>more</p><div class=comments><p>" + "long comment " * 90 + "</p></div></div>": "text of it\nmore",
    "<script>var t='</p>';</script><style>p{}</style><p>x</p><!-- c -->": "x",
    "<article><section><p>first part is here</p></section><section><h2>q</h2><p>second part</p></section></article><div class=ad>buy</div>": "first part is here\nq\nsecond part",
    "<ul><li>a<li>b</ul>": "a\nb",
    "<p>a < b & c</p>": "a < b & c",
    "<div>" * 20_000 + "deep": "deep",
    "<body><div class=ad>only an advert</div></body>": "",
}


def test_main_text(spark):
    rows = [(n, "u", h) for n, h in enumerate(PAGES)] + [(99, None, None), (99, None, None)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as text")).collect()
    assert sorted((r["page_id"], r["text"]) for r in got) == sorted([*enumerate(PAGES.values()), (99, ""), (99, "")])


def paragraphs(n, letter):
    return "".join(f"<p>{letter * 9} {k} {'word ' * 40}</p>" for k in range(n))


def test_every_dense_section_is_text():
    links = "<ul>" + "".join(f"<li><a href=x>entry {k}</a></li>" for k in range(40)) + "</ul>"
    tree = html_text.Tree(html_text.fixed())

    def blocks(page):
        return html_text.main_text(page, tree).split("\n")

    def starts(page):
        return [b[0] for b in blocks(page)]

    # sections in one wrapper, without article or main; the list of links is left out
    assert starts(f"<body><div id=page>{links}<div>{paragraphs(10, 'a')}</div><div>{paragraphs(3, 'b')}</div></div>") == ["a"] * 10 + ["b"] * 3
    # and one wrapper further down
    assert starts(f"<body><div><div id=page>{links}<div>{paragraphs(3, 'a')}</div><section><div>{paragraphs(10, 'b')}</div></section></div></div>") == ["a"] * 3 + ["b"] * 10
    # blocks of unlike length straight in the body
    assert starts(f"<body><h2><a href=x>title</a></h2>{paragraphs(1, 'a')}<p>{'c' * 5000}</p>{links}") == ["t", "a", "c"]
    # an article is whole
    assert starts(f"<body><div><article>{links}<div>{paragraphs(4, 'a')}</div><p>z</p></article></div>") == ["e"] * 40 + ["a"] * 4 + ["z"]


@pytest.mark.parametrize(
    "wrapper",
    ["div class='content has-sidebar'", "div class='post comments-open'", "div id='page' class='no-sidebar'", "section id='related-work'", "div class='ad-free'", "div class='sidebar-left'", "div class=menu"],
)
def test_a_wrapper_with_a_listed_word_keeps_its_text(wrapper):
    tree, name = html_text.Tree(html_text.fixed()), wrapper.split()[0]
    page = "<body><div class='site-header'>top</div><{}><p>{}</p><p>of it</p></{}><div class='sidebar left'><p>aside</p></div><div class='comments-area'>c</div>"
    assert html_text.main_text(page.format(wrapper, "the text " * 20, name), tree) == ("the text " * 20).strip() + "\nof it"


SENTENCE = "Sentence {} of the article is long enough to count as the text of a page, and it goes on for a while."
COMMENT = "<p>I think that all of this is wrong, and want to say so at some length here.</p>"


@pytest.mark.parametrize(
    ("page", "titles"),
    [
        ("<body><form id='aspnetForm'><div>{0}<input><select><option>x</select><button>Send</button></div></form></body>", []),
        ("<body><form id='aspnetForm'><article>{0}</article></form><div class=promo>more</div></body>", []),
        ("<body><div class='ad-container'>{0}</div></body>", []),
        ("<body><article>{0}<section id='cookies'><h2 id='cookies'>Cookies</h2></section><section id='navigation'><h2>Menus</h2></section></article></body>", ["Cookies", "Menus"]),
        ("<body><div class='post'>{0}</div><ol class='commentlist'><li>" + COMMENT + "</li></ol></body>", []),
        ("<body><div class='post'>{0}</div><section class='user-comments'>" + COMMENT * 9 + "</section></body>", []),
        ("<body><article>{0}<div id='comments'>" + COMMENT + "</div></article></body>", []),
        ("<body>{0}<div class='legal'>Terms apply to all of this.</div><div class='box'>Subscribe now to our letter</div></body>", []),
        ("<body><form class='search'><input> Find it</form>{0}<form><p>Your name</p><textarea></textarea></form></body>", []),
    ],
)
def test_wrappers_anchors_comments_and_boxes(page, titles):
    text = html_text.main_text(page.format("".join(f"<p>{SENTENCE.format(k)}</p>" for k in range(3))), html_text.Tree(html_text.fixed()))
    assert text.split("\n") == [SENTENCE.format(k) for k in range(3)] + titles


def densities_by_hand(page):
    """(tag, density) of every element of a well-formed page, each from its whole subtree: the published formula with one more inside its logarithms."""
    root = ElementTree.fromstring(page)
    size = lambda e: len("".join("".join(e.itertext()).split()))
    links = lambda e: [a for a in e.iter("a")]
    outer = lambda e: [a for a in links(e) if not any(a is not b and a in list(b.iter()) for b in links(e))]
    body = root.find("body")
    share = sum(map(size, outer(body))) / size(body) if size(body) else 0
    out = []
    for e in root.iter():
        c, lc = size(e), size(e) if e.tag == "a" else sum(map(size, outer(e)))
        if c:
            t, lt = max(len(list(e.iter())) - 1, 1), max(len([a for a in links(e) if a is not e]), 1)
            out.append((e.tag, c / t * np.log(1 + c * t / (max(lc, 1) * lt)) / np.log(1 + np.log(c * lc / max(c - lc, 1) + share * c + np.e))))
        else:
            out.append((e.tag, 0.0))
    return out


def test_densities_by_hand():
    rng = random.Random(6)

    def node(depth):
        if depth == 0 or rng.random() < 0.3:
            text = " ".join("word" for _ in range(rng.randint(0, 12)))
            return f"<a>{text}</a>" if rng.random() < 0.3 else f"<span>{text}</span>"
        return f"<div>{''.join(node(depth - 1) for _ in range(rng.randint(1, 4)))}</div>"

    tree = html_text.Tree(html_text.fixed())
    for _ in range(60):
        page = f"<html><body>{node(4)}{node(3)}</body></html>"
        html_text.main_text(page, tree)
        want = densities_by_hand(page)
        assert tree.tag[1:] == [t for t, _ in want] and np.allclose(html_text.densities(tree).density[1:], [d for _, d in want])


def test_pages_empty_long_and_clashing(spark):
    """No rows; a page longer than a block of pages; columns named as the results."""
    kinds = "page_id bigint, url string, html string, text string, n_chars bigint"
    assert html_text.extract(spark.createDataFrame([], kinds)).collect() == []
    long = "<body><article>" + "".join(f"<p>{SENTENCE.format(k)}</p>" for k in range(3000)) + "</article></body>"
    rows = [(n, "u", long if n == 2 else f"<p>page {n}</p>", "x", 1) for n in range(5)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, kinds).coalesce(1), block_chars=1000).collect()}
    assert got[2].split("\n") == [SENTENCE.format(k) for k in range(3000)] and all(got[n] == f"page {n}" for n in (0, 1, 3, 4))


def test_names_with_an_article_inside():
    tree = html_text.Tree(html_text.fixed())
    page = "<body><div class=promo><article><p>one</p></article></div><div class=promo><main><p>two</p></main></div><div class=ad>buy</div>"
    assert html_text.main_text(page, tree) == "one\ntwo"
    page = "<body><main><p>the text of it</p></main><div class='related-posts'><article><p>other</p></article></div>"
    assert html_text.main_text(page, tree) == "the text of it"


def test_page_query_equals_the_articles(spark, sf_dir):
    import html
    import re

    pages = dict(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").collect())
    for r in queries.op5_html(spark, sf_dir).collect():
        article = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1].replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub("<[a-z/][^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_a_block_of_new_words_takes_little_memory():
    """What a worker holds while it encodes words that it has never seen: its table and one block's arrays."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        encoder = bpe.FragmentEncoder(f.read())
    text = b" ".join(b"w%d" % n for n in range(600_000))[: 3 << 20]
    tracemalloc.start()
    for _ in encoder.encode(text[k : k + 1000] for k in range(0, len(text), 1000)):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6
