"""Operators across documents, vectors and URLs, against brute force or SQL."""

import hashlib
import random
import re
import time
import tracemalloc
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from compare import assert_same, oracle
from pyspark.sql import functions as F

from tallyspark.llm import ngram_join, pq_dedup, queries, suffix_dedup, topk, urls
from tallyspark.llm.shared import Workspace, components


class Groups(dict):
    """Smallest member of each group of joined items."""

    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def number(i):
    return -1 if i is None else i


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode()))
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def near_duplicates(rows):
    """{id: component} of all pairs, and the set sizes of the rows."""
    groups = Groups()
    sets = [(i, s) for i, t in rows if i is not None and (s := shingles(t))]
    for i, _ in rows:
        if i is not None:
            groups.find(i)
    by_gram = defaultdict(list)
    for n, (i, s) in enumerate(sets):
        shared = defaultdict(int)
        for g in s:
            for m in by_gram[g]:
                shared[m] += 1
            by_gram[g].append(n)
        for m, both in shared.items():
            if 100 * both >= 75 * (len(s) + len(sets[m][1]) - both):
                groups.join(i, sets[m][0])
    return sorted((number(i), len(shingles(t)), number(i if i is None else groups.find(i))) for i, t in rows)


def ngram_rows(frame):
    return sorted((number(r["doc_id"]), r["n_shingles"], number(r["component_id"])) for r in frame.collect())


def test_ngram_join_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert ngram_rows(queries.op4_ngram_join(spark, sf_dir)) == near_duplicates([(i, t) for i, t in rows])


@pytest.mark.parametrize(("query", "sql"), [(queries.op2_suffix_dedup, queries.OP2_SQL), (queries.op4_ngram_join, queries.OP4_SQL)])
def test_documents_as_by_sql(spark, query, sql):
    sf_dir = "/root/testdata/sf0.01"
    assert_same(query(spark, sf_dir).toPandas(), oracle(sf_dir, sql))


def test_ngram_join_chains_copies_and_odd_rows(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    line = [word() for _ in range(12)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "Two Words"), (5, "two words"), (6, "words two"), (None, "two words"), (7, "é " * 9), (8, "É " * 9)]
    base = [word() for _ in range(80)]
    chain, n = base, 10
    for _ in range(14):  # neighbours are linked, ends are not
        chain = [*chain[5:], *(word() for _ in range(5))]
        rows.append((n, " ".join(chain)))
        n += 1
    for _ in range(25):  # near copies of one text around the threshold, and copies
        copy = base[:]
        for at in rng.sample(range(80), rng.randint(0, 3)):
            copy[at] = word()
        rows += [(n, " ".join(copy)), (n + 1, " ".join(copy).upper())][: 1 + n % 2]
        n += 2
    for _ in range(20):  # a very common line in unlike texts
        rows.append((n, " ".join([*line, *(word() for _ in range(6))])))
        n += 1
    rows += [(n, " ".join(base)), (n, "quite another text of its own here"), (n + 1, "quite another text of its own here")]
    rows.append((n + 5, " ".join(base * 400)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as id", "2 as n", "3 as gram", "4 as node", "5 as component")
    assert ngram_rows(ngram_join.join(frame, entries_per_block=200, frequent_rows=8)) == near_duplicates(rows)
    assert ngram_rows(ngram_join.join(frame.repartition(5), broadcast_ids=0, lanes=())) == near_duplicates(rows)


def test_ngram_join_of_nothing(spark):
    frame = spark.createDataFrame([], "doc_id bigint, text string")
    assert ngram_join.join(frame).collect() == []


def removed_by_hand(rows, length=50):
    """{id: (n_bytes, removed, runs, digest of what is left)} for rows of distinct ids."""
    first, out = {}, {}
    for i, text in sorted((i, (t or "").encode()) for i, t in rows):
        covered = bytearray(len(text))
        windows = [text[p : p + length] for p in range(len(text) - length + 1)]
        for p, w in enumerate(windows):
            if first.get(w, i) < i:
                covered[p : p + length] = b"\1" * length
        for w in windows:
            first.setdefault(w, i)
        left = bytes(b for b, c in zip(text, covered, strict=True) if not c)
        runs = len(re.findall(rb"\x01+", bytes(covered)))
        out[i] = (len(text), sum(covered), runs, hashlib.sha256(left).hexdigest())
    return out


def digests(frame):
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"])
    return {r[0]: tuple(r[1:]) for r in frame.select("doc_id", "n_bytes", removed, F.size("spans"), F.sha2("kept", 256)).collect()}


def test_suffix_dedup_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op2_suffix_dedup(spark, sf_dir).collect()}
    assert got == removed_by_hand(rows)


def test_suffix_dedup_odd_rows(spark, monkeypatch):
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abc") for _ in range(n))
    passage, exact = noise(300), noise(50)
    rows = [(1, None), (2, ""), (3, "short"), (4, exact), (5, noise(49) + exact + noise(3)), (6, exact[:49]), (7, "a" * 400), (8, "b" + "a" * 50 + "b"), (9, "ab" * 100), (10, "é" * 200), (11, "xé" * 10 + "é" * 60)]
    for n in range(12, 40):
        a = rng.randint(0, 240)
        rows.append((n, noise(rng.randint(0, 90)) + passage[a : a + rng.randint(30, 300)] + noise(rng.randint(0, 90))))
    rows += [(40, rows[20][1]), (41, rows[20][1]), (42, noise(9000) + passage + noise(40))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "7 as id", "8 as chunk", "9 as blob", "10 as kept")
    assert digests(suffix_dedup.remove_repeats(frame)) == removed_by_hand(rows)
    # many chunks and groups, and long texts in segments
    import tallyspark.llm.suffix_dedup as module

    monkeypatch.setattr(module, "SEGMENT", 1000)
    assert digests(suffix_dedup.remove_repeats(frame.repartition(6), chunk_bytes=1000, group_phrases=50)) == removed_by_hand(rows)


def test_suffix_dedup_null_and_equal_ids(spark):
    text = "".join(random.Random(6).choice("abcdef") for _ in range(200))
    rows = [(None, text), (5, text), (5, text), (7, text), (7, text), (None, text)]
    got = sorted((r["doc_id"] or 0, len(r["spans"]), r["c"]) for r in suffix_dedup.remove_repeats(spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id bigint, text string, c string"), keep=["c"]).collect())
    assert got == [(0, 0, "c"), (0, 0, "c"), (5, 0, "c"), (5, 0, "c"), (7, 1, "c"), (7, 1, "c")]
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_suffix_dedup_either_phrase_hash_tells_phrases_apart():
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab") for _ in range(400)).encode() for _ in range(20)]
    blob = suffix_dedup.packed(pa.table({"id": pa.array(range(40), pa.int64()), "text": pa.array(texts * 2, pa.binary())}))

    class Weak(suffix_dedup.Parser):
        def __init__(self, which):
            super().__init__(50, 16)
            self.which = which

        def triggers(self, text):
            place, *hashes = super().triggers(text)
            hashes[self.which] = np.zeros(len(place), np.uint64)
            return place, *hashes

    whole = suffix_dedup.Chunk([blob], suffix_dedup.Parser(50, 16), 1)
    phrases = {(p, whole.texts[r][max(0, p - 34) : p + 50], min(p, 34)) for r, p in zip(whole.row[whole.first].tolist(), whole.place[whole.first].tolist(), strict=True)}
    assert len({x[1:] for x in phrases}) == len(whole.first) < len(whole.place)
    for which in (1, 2):
        assert len(suffix_dedup.Chunk([blob], Weak(which), 1).first) == len(whole.first)


def test_suffix_dedup_holds_memory_for_the_texts_at_hand_only():
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(1000)).encode() for _ in range(200)]
    blob = suffix_dedup.packed(pa.table({"id": pa.array(range(200), pa.int64()), "text": pa.array(texts, pa.binary())}))
    tracemalloc.start()
    suffix_dedup.Chunk([blob], suffix_dedup.Parser(50, 16), 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4_000_000  # 200 KB of texts


def test_suffix_dedup_leaves_no_names_in_the_catalog(spark):
    frame = suffix_dedup.remove_repeats(spark.createDataFrame([(1, "x" * 60), (2, "x" * 60)], "doc_id bigint, text string"))
    assert len(frame.collect()) == 2
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("tallyspark_")]


def linked_by_hand(rows, threshold=0.95):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    return [r for n in {len(v) for _, v in good} for r in linked_of_length([g for g in good if len(g[1]) == n], threshold)]


def linked_of_length(good, threshold):
    x = np.stack([v / np.linalg.norm(v) for _, v in good])
    hits = x @ x.T >= threshold
    groups, count = Groups(), defaultdict(int)
    for a, b in zip(*np.nonzero(hits), strict=True):
        if a != b:
            groups.join(good[a][0], good[b][0])
            count[a] += 1
    out = [(i, count[n], groups.find(i)) for n, (i, _) in enumerate(good)]
    return out


def vector_rows():
    rng = np.random.default_rng(8)
    rows = [(n, rng.normal(size=16).tolist()) for n in range(300)]
    for n in range(300, 500):
        rows.append((n, (np.array(rows[n % 7][1]) + rng.normal(size=16) * 0.13).tolist()))
    rows += [(n, rows[3][1]) for n in range(500, 560)]
    # other lengths: many vectors, and a few
    rows += [(n, [1.0, float(n % 9), 3.0]) for n in range(560, 760)] + [(760, [1.0, 2.0, 3.0, 4.0, 5.0]), (761, [2.0, 4.0, 6.0, 8.0, 10.0]), (762, [5.0, 4.0, 3.0, 2.0, 1.0])]
    return rows


def test_vectors_link_as_by_brute_force(spark):
    rows = vector_rows()
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None] * 8), (904, [1.0] * 6), (905, []), (906, [float("inf")] + [0.0] * 15), (None, [1.0] * 16)]
    frame = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>").selectExpr("*", "1 as rep", "2 as copies", "3 as list")
    got = pq_dedup.link(frame, block=64, list_rows=32).collect()
    assert len(got) == len(rows) + len(odd)
    want = linked_by_hand(rows)
    by_id = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got}
    right = sum(by_id[i] == (n, c) for i, n, c in want)
    assert right >= 0.99 * len(want)
    assert all(by_id[i][0] <= n for i, n, _ in want)
    assert all(by_id[i] == (0, i) for i, _ in odd)
    assert pq_dedup.link(frame.limit(0)).collect() == []


def test_vectors_of_lengths_that_the_sample_lacks(spark):
    rows = vector_rows()
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pq_dedup.link(frame, sample_rows=1, most_sample_rows=1, block=100).collect()}
    single = [(i, np.array(v, np.float32).tolist()) for i, v in rows]
    assert got == {i: (n, c) for i, n, c in linked_by_hand(single)}


def test_vector_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in queries.op7_embeddings(spark, sf_dir).collect())
    assert got == sorted(linked_by_hand(rows))
    assert_same(queries.op7_embeddings(spark, sf_dir).toPandas(), oracle(sf_dir, queries.OP7_SQL))


def test_urls_query(spark, sf_dir):
    assert_same(queries.op8_urls(spark, sf_dir).toPandas(), oracle(sf_dir, queries.OP8_SQL))


def test_urls_odd_rows(spark):
    cases = [
        (1, None, "", "", None, "allow"),
        (2, "no scheme/x", "", "", None, "allow"),
        (3, "http://EXAMPLE.org/es/1?q#f", "example.org", "/es/1", "example.org/es/", "block"),
        (4, "http://a.b.example.org/en/12", "a.b.example.org", "/en/12", "example.org/en/1", "block"),
        (5, "http://example.org/fr", "example.org", "/fr", "org/", "allow"),
        (6, "x://com", "com", "", None, "allow"),
        (7, "x://notcom/de/", "notcom", "/de/", None, "allow"),
        (8, "x://b.com/de/?x=://org/", "b.com", "/de/", "com/de/", "block"),
        (9, "", "", "", None, "allow"),
        (10, "x://com/de/" + "y" * 50_000, "com", "/de/" + "y" * 50_000, "com/de/", "block"),
        (10, "x://com/de/" + "y" * 50_000, "com", "/de/" + "y" * 50_000, "com/de/", "block"),
        (None, "x://com/de/", "com", "/de/", "com/de/", "block"),
    ]
    pages = spark.createDataFrame([c[:2] for c in cases], "page_id bigint, url string").selectExpr("*", "'h' as host", "'p' as path", "1 as key", "2 as block", "3 as words")
    listed = spark.createDataFrame(queries.RULES, "host string, path string, verdict string")
    key = lambda r: (r[0] or 0, *map(str, r[1:]))
    for few in (200_000, 0):  # broadcast, and joined by shuffle
        got = urls.judge(pages, listed, broadcast_rows=few)
        assert sorted(map(tuple, got.select("page_id", "url", "host", "path", "rule", "verdict").collect()), key=key) == sorted(cases, key=key)
    assert {r["verdict"] for r in urls.judge(pages, listed.limit(0)).collect()} == {"allow"}
    assert urls.judge(pages.limit(0), listed).collect() == []


def test_bloom_filter_has_no_false_negatives(spark):
    listed = spark.range(5000).selectExpr("concat('h', id, '.org') as host", "'/' as path", "'block' as verdict")
    pages = spark.range(10_000).selectExpr("id as page_id", "concat('http://h', id, '.org/x') as url")
    got = urls.judge(pages, listed).groupBy("verdict").count().collect()
    assert dict(map(tuple, got)) == {"allow": 5000, "block": 5000}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_topk_query(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    assert_same(queries.op10_topk(spark, sf_dir).toPandas(), oracle(sf_dir, queries.OP10_SQL))


def test_topk_odd_rows(spark):
    rng = np.random.default_rng(9)
    rows = [(n, rng.normal(size=8).tolist()) for n in range(700)]
    rows += [(n, rows[5][1]) for n in range(700, 800)] + [(900, None), (1000, [None] * 8), (1100, [float("nan")] * 8), (1200, [1.0] * 3), (1300, [2.0] * 3), (1400, []), (None, [1.0] * 8), (0, rows[0][1])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 as b", "2 as q", "3 as score", "4 as length")
    got = topk.search(frame, F.col("vec_id") % 100 == 0, block=100, query_block=3)
    good = [(i, np.floor(1024 * np.array(v)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q, x in {i: v for i, v in good if i % 100 == 0}.items():
        ranked = sorted((-int(x @ y), i) for i, y in good if i != q and len(y) == len(x))[:10]
        want |= {(q, n, i, -s) for n, (s, i) in enumerate(ranked, 1)}
    assert {tuple(r) for r in got.collect() if r["query_id"]} == {w for w in want if w[0]}
    # components too large for exact doubles
    big = spark.createDataFrame([(0, [1e15, 3.0]), (1, [1e15, 1.0]), (2, [1e15, 2.0])], "vec_id bigint, embedding array<double>")
    assert [r["vec_id"] for r in topk.search(big, F.col("vec_id") == 0).orderBy("rank").collect()] == [1, 2]
    assert topk.search(frame.limit(0), F.lit(True)).collect() == []


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(300)] + [(n, n + 1) for n in range(1000, 1060)] + [(5000, n) for n in range(6000, 6200)] + [(7, 7), (None, 3)]
    groups = Groups()
    for a, b in edges:
        if a is not None and a != b:
            groups.join(a, b)
    for task_edges in (1 << 20, 0):  # in one task, and by rounds
        got = components(spark.createDataFrame(edges, "src bigint, dst bigint"), Workspace(spark), task_edges).collect()
        assert dict(map(tuple, got)) == {x: groups.find(x) for x in list(groups)} and len(got) == len(groups)


def test_recall_with_many_more_lists_than_probes():
    """The coarse stage by itself: near pairs of 64 components, over lists in the hundreds and eight probes."""
    rng = np.random.default_rng(9)
    x = pq_dedup.unit(rng.normal(size=(6000, 64)))
    y = pq_dedup.unit(x + rng.normal(size=x.shape) * rng.uniform(0.01, 0.04, (len(x), 1)))
    close = (x * y).sum(1) >= 0.95
    quantiser = pq_dedup.fit(np.concatenate([x, y]), 12_000, 16, 64, 24, 500, 3)
    assert len(quantiser.centroids) >= 400 and close.sum() > 2000
    homes = np.array([n[0] for n in pq_dedup.probed(y, quantiser, (2 - 2 * 0.95) ** 0.5, 8)])
    found = np.array([h in n for h, n in zip(homes, pq_dedup.probed(x, quantiser, (2 - 2 * 0.95) ** 0.5, 8), strict=True)])
    back = np.array([h[0] in n for h, n in zip(pq_dedup.probed(x, quantiser, (2 - 2 * 0.95) ** 0.5, 8), pq_dedup.probed(y, quantiser, (2 - 2 * 0.95) ** 0.5, 8), strict=True)])
    assert (found | back)[close].mean() >= 0.9
    # with as many probes as lists the planes' bound loses none
    assert all(h in n for h, n in zip(homes[close], [p for p, c in zip(pq_dedup.probed(x, quantiser, (2 - 2 * 0.95) ** 0.5, 500), close, strict=True) if c], strict=True))


def test_long_vectors_bound_the_sample(spark):
    """A sample of few components still indexes and links every row."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 8))
    rows = [(n, (base[n % 40] + rng.normal(size=8) * 0.01).tolist()) for n in range(200)]
    got = pq_dedup.link(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), most_sample_values=160).collect()
    assert {r["vec_id"]: r["component_id"] for r in got} == {n: n % 40 for n in range(200)} and all(r["n_links"] == 4 for r in got)


def test_suffix_dedup_deals_rows_to_many_chunks_without_copying_all_for_each():
    class Caught(Exception):
        pass

    class Rows:
        columns = ["id", "text", "chunk"]

        def mapInArrow(self, run, schema):  # noqa: N802
            raise Caught(run)

    def seconds(chunks, n=12_000):
        rng = np.random.default_rng(3)
        texts = [rng.bytes(1000).hex() for _ in range(n)]
        chunk = rng.integers(0, chunks, n).astype(np.int32)
        table = pa.table({"id": pa.array(range(n), pa.int64()), "text": texts, "chunk": chunk})
        with pytest.raises(Caught) as caught:
            suffix_dedup._clustered(Rows(), chunks, None)
        began = time.process_time()
        out = pa.Table.from_batches(caught.value.args[0](iter(table.to_batches(500))))
        took = time.process_time() - began
        found = {(i, t, c) for c, blob in zip(out["chunk"].to_pylist(), out["blob"].to_pylist(), strict=True) for i, t in zip(*(suffix_dedup.unpacked(blob)[k].to_pylist() for k in ("id", "text")), strict=True)}
        assert found == set(zip(range(n), texts, chunk.tolist(), strict=True))
        return took

    assert seconds(6000) < 3 + 5 * seconds(10)


def test_suffix_dedup_asks_only_for_phrases_that_can_share_a_string(spark, monkeypatch):
    """Texts with one line of 30 bytes: its triggers have a phrase of each text, none of them with 50 bytes in common."""
    rng = random.Random(12)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    spaces = []
    monkeypatch.setattr(suffix_dedup, "Workspace", lambda s: spaces.append(Workspace(s)) or spaces[-1])
    for shared, asked in ((noise(30), False), (noise(60), True)):
        rows = [(i, noise(200) + shared + noise(200)) for i in range(60)]
        assert digests(suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"))) == removed_by_hand(rows)
        status = [b for r in spark.read.parquet(f"{spaces[-1].root}/1").collect() for b in r["blob"]]
        assert (2 in status) == asked


def test_suffix_dedup_leaves_no_shuffle_files_of_dealing(spark):
    folders = [Path(d.getPath()) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {p for d in folders for p in d.glob("*/shuffle_*.data")}
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(n, rng.bytes(2000).hex(), n % 5) for n in range(300)], "id bigint, text string, chunk int")
    before = files()
    dealt = suffix_dedup._clustered(rows, 5, Workspace(spark))
    until = time.time() + 10
    while (left := files() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert sum(suffix_dedup.unpacked(r["blob"]).num_rows for r in dealt.collect()) == 300
