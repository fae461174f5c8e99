"""Manifests, periodic runs and nearest neighbours, against brute force and SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import assert_same, oracle
from pyspark.sql import functions as F

from tallyspark.llm import block_ann, merkle, queries, tandem
from tallyspark.llm.shared import Workspace

NEW = ["op11_block_ann", "op12_manifest", "op13_runs"]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", NEW)
def test_query_equals_its_sql(spark, name, sf):
    d = f"/root/testdata/{sf}"
    assert_same(queries.queries()[name](spark, d).toPandas(), oracle(d, queries.oracle_sql()[name]))


@pytest.mark.parametrize("name", NEW)
def test_empty_tables(spark, tmp_path, name):
    for t in ("documents", "embeddings"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert queries.queries()[name](spark, str(tmp_path)).collect() == []


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def put(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def heights(leaves, fanout):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def beside(tree, place, fanout):
    """[(before, after)] from the leaf up."""
    out = []
    for nodes in tree[:-1]:
        first = place - place % fanout
        out.append(("".join(nodes[first:place]), "".join(nodes[place + 1 : first + fanout])))
        place //= fanout
    return out


def manifest_by_hand(rows, fanout=2):
    """Of rows (id, source, lang, n, text): sorted (id, leaf, path, subroot, root)."""
    groups = {}
    for i, source, lang, n, text in rows:
        groups.setdefault(lang, []).append((i is not None, i or 0, sha(put(i) + put(source) + put(lang) + put(n) + put(text)), i))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [heights([r[2] for r in sorted(groups[g], key=lambda r: r[:3])], fanout) for g in names]
    top = heights([t[-1][0] for t in trees], fanout)
    out = []
    for k, (g, tree) in enumerate(zip(names, trees, strict=True)):
        for place, (_, _, leaf, i) in enumerate(sorted(groups[g], key=lambda r: r[:3])):
            out.append((repr(i), leaf, beside(tree, place, fanout) + beside(top, k, fanout), tree[-1][0], top[-1][0]))
    return sorted(out)


@pytest.mark.parametrize(("fanout", "height", "bucket"), [(2, 10, 4096), (2, 2, 3), (3, 1, 5), (5, 2, 40)])
def test_manifest_of_odd_rows(spark, fanout, height, bucket):
    """Null ids and groups, a group and an id with a third of all rows, equal rows, ids far apart, a group's name that begins another's."""
    rng = random.Random(fanout * height)
    rows = [(None, "s", "en", None, "x"), (None, None, None, 1, None), (2**63 - 1, "s", "e", 3, "é"), (-(2**63), "s", "e", 3, ""), (5, "s", "", 0, "lone")]
    rows += [(7, "s", "en", 1, "same")] * 30 + [(7, "s", "en", 1, f"text {n}") for n in range(20)]
    rows += [(rng.choice([rng.randrange(40), 2**40 + rng.randrange(40), -rng.randrange(5)]), "s", rng.choice(["en", "en-x", "de", None]), rng.randrange(9), "漢字") for _ in range(60)]
    frame = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").withColumns({c: F.lit(1) for c in ("id", "key", "group", "rank", "bucket")}).repartition(5)
    got = merkle.manifest(frame, fanout=fanout, height=height, bucket=bucket).withColumn("ends", merkle.folded(F.col("leaf"), F.col("path"))).collect()
    assert sorted((repr(r["doc_id"]), r["leaf"], [tuple(s) for s in r["path"]], r["subroot"], r["root"]) for r in got) == manifest_by_hand(rows, fanout)
    assert all(r["ends"] == r["root"] and r["forged"] == r["leaf"] for r in got)


def test_a_changed_field_no_longer_leads_to_the_root(spark):
    frame = spark.createDataFrame([(n, "s", "en", n, "t") for n in range(9)], "doc_id bigint, source string, lang string, n_chars bigint, text string")
    got = merkle.manifest(frame, tampered={"text": F.when(F.col("doc_id") == 4, "T").otherwise(F.col("text"))})
    assert {r["doc_id"] for r in got.where(merkle.folded(F.col("forged"), F.col("path")) != F.col("root")).collect()} == {4}


def test_ranks_refine_only_where_keys_gather(spark):
    keys = [f"{n:08x}" for n in [*range(300), *range(2**31, 2**31 + 5), 2**32 - 1]] + ["0000", "000000"]
    frame = spark.createDataFrame([("g", k) for k in keys], "group string, key string")
    got = {r["key"]: r["rank"] for r in merkle.ranks(frame.withColumn("k", F.col("key")), Workspace(spark), bucket=4).rows.select(F.col("k").alias("key"), "rank").collect()}
    assert got == {k: n for n, k in enumerate(sorted(keys))}


def runs_by_hand(words, least, exponent):
    out = []
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length, part = j + q - i, words[i : j + q]
            if j > i and length >= max(least, exponent * q) and not any(all(part[t] == part[t + d] for t in range(length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize(("least", "exponent"), [(6, 4), (2, 2), (7, 3)])
def test_runs_equal_brute_force(least, exponent):
    rng = random.Random(least)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 4)):
            letters, n = rng.randint(1, 4), rng.randint(0, 60)
            words = [str(rng.randrange(letters)) for _ in range(n)]
            if rng.random() < 0.5 and n:
                a, p = rng.randrange(n), rng.randint(1, 8)
                words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
            texts.append(words * rng.choice([1, 1, 2, 4]))
        assert tandem.runs_of_texts(texts, least, exponent) == [runs_by_hand(w, least, exponent) for w in texts]


def squares_by_hand(x):
    return {tuple(x[i : i + 2 * k]) for k in range(1, len(x) // 2 + 1) for i in range(len(x) - 2 * k + 1) if x[i : i + k] == x[i + k : i + 2 * k] and not any(k % d == 0 and x[i : i + k] == x[i : i + d] * (k // d) for d in range(1, k))}


def test_covering_squares_turn_into_the_whole_vocabulary():
    """The published steps by themselves: blocks, covering squares and their turns to the right, for two words of Fibonacci and at random."""
    rng, words = random.Random(5), [[0], [0, 1]]
    while len(words) < 9:
        words.append(words[-1] + words[-2])
    for x in [words[-1], [0] * 33, *([rng.randrange(3) for _ in range(rng.randint(2, 70))] for _ in range(60))]:
        codes = np.unique(x, return_inverse=True)[1].astype(np.int64)
        levels = tandem.doubled_ranks(codes)
        isa = levels[-1][:-1].astype(np.int64)
        sa = np.argsort(isa)
        starts, lengths = tandem.lempel_ziv(sa, isa, levels)
        assert starts.tolist() == [0, *np.cumsum(lengths)[:-1].tolist()]
        for at, n in zip(starts.tolist(), lengths.tolist(), strict=True):  # each is the longest that begins earlier, or new
            earlier = lambda m: any(x[s : s + m] == x[at : at + m] for s in range(at))  # noqa: B023, E731
            assert (earlier(n) or n == 1) and not (at + n < len(x) and earlier(n + 1))
        start, k = tandem.covering_squares(levels, starts, lengths, np.full(len(starts), len(x)))
        found = set()
        for s, half in zip(start.tolist(), k.tolist(), strict=True):
            while s + 2 * half <= len(x) and x[s : s + half] == x[s + half : s + 2 * half]:
                found.add(tuple(x[s : s + 2 * half]))
                s += 1
        assert found == squares_by_hand(x)


def test_runs_of_odd_rows(spark):
    line = "a b c d"
    texts = [None, "", " \t\n", "x " * 5, "x " * 6, f"\n{line} {line}\t{line} {line} a b", "é é " * 7, "no run here", "y\r\ny\x0by y y y " + "z " * 8]
    texts += ["w%d" % (n % 997) for n in range(3)] + [" ".join(f"w{n % 997}" for n in range(60_000))]
    rows = [(None if n % 4 == 3 else n % 6, t, n) for n, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, runs int").repartition(3)
    got = tandem.find_runs(frame.withColumns({"n_words": F.lit(0), "number": F.col("runs"), "collapsed": F.lit("")}), keep=["number"], block_chars=60).collect()
    assert len(got) == len(rows)
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r["number"]] or "")
        want = runs_by_hand(words, 6, 4) if len(words) < 1000 else [(0, 60_000, 997)]
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert (r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]]) == (rows[r["number"]][0], len(words), want)
        assert r["collapsed"] == " ".join(w for i, w in enumerate(words) if i not in gone)


def test_planted_texts_by_hand(spark, sf_dir):
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    for r in queries.op13_runs(spark, sf_dir).collect():
        words, h = re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]] or ""), zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and words:
            g = h // 10
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(len(words))]
        if len(words) > 2000:
            continue
        runs = runs_by_hand(words, 6, 4)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["runs_sha256"] == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))


def nearest_by_hand(rows, is_query, k):
    """Sorted (query, rank, id, score) over all pairs of rows; of the products of equal length, summed in order."""
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for query in sorted({i for i, _ in good if is_query(i)}):
        found = []
        for _, v in (r for r in good if r[0] == query):
            for i, w in good:
                if i != query and len(v) == len(w):
                    total = 0.0
                    for a, b in zip(v, w, strict=True):
                        total += a * b
                    found.append((-total, i))
        out += [(query, n + 1, i, -s) for n, (s, i) in enumerate(sorted(found)[:k])]
    return out


def test_neighbours_of_odd_rows(spark):
    """Copies with a third of all rows, ties, repeated and null ids, vectors that take no part, other lengths, huge and tiny components."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 8))
    rows = [(n, [1.0, -2.0, 0.5, 0.0, 0.0, 0.0, 0.0, 3.0]) for n in range(200)]
    rows += [(1000 + n, (centres[n % 5] + rng.normal(size=8) * 10.0 ** -(n % 7)).tolist()) for n in range(300)]
    rows += [(2000 + n, (rng.integers(-2, 3, 8)).astype(float).tolist()) for n in range(60)]
    rows += [(3000 + n, rng.normal(size=3).tolist()) for n in range(9)] + [(4000, [1.0]), (4010, [-1.0])]
    rows += [(5000, None), (5010, []), (5020, [0.0] * 8), (5030, [1.0, float("nan")] * 4), (5040, [1.0, None] * 4), (None, [1.0] * 8), (5050, [float("inf")] * 8)]
    rows += [(6000, [1e150] * 8), (6001, [-1e150] * 8), (6010, [1e-170] * 8), (10, rows[0][1]), (1001, centres[0].tolist()), (1000, centres[1].tolist())]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "vector", "asks", "b", "p", "floor", "rank")}).repartition(3)
    got = block_ann.search(frame, F.col("vec_id") % 10 == 0, k=7, least_block=24, query_values=200, growth=3)
    assert sorted(map(tuple, got.collect())) == nearest_by_hand(rows, lambda i: i % 10 == 0, 7)


def test_bounds_hold_for_every_pair():
    rng = np.random.default_rng(1)
    for scale in (1e-200, 1.0, 1e120):
        a, b = rng.normal(size=(40, 2100)) * scale, rng.standard_cauchy(size=(50, 2100)) * scale
        near, off = block_ann.Codes(a).bounds(block_ann.Codes(b), slice(0, 40), slice(0, 50))
        with np.errstate(under="ignore"):
            assert (np.abs(a @ b.T - near) <= off).all()


def test_tiles_drop_most_pairs(monkeypatch):
    """Of 200 x 6,000 pairs few are left for double precision, and the answer is that of all pairs."""
    rng, count = np.random.default_rng(2), Counter()
    q, rows = rng.normal(size=(200, 64)), rng.normal(size=(6000, 64))
    plain = block_ann.products
    monkeypatch.setattr(block_ann, "products", lambda a, b: count.update(n=len(a)) or plain(a, b))
    heaps = block_ann.join_blocks(q, np.arange(200) - 200, np.full(200, -np.inf), rows, np.arange(6000), 20)
    assert count["n"] < 0.03 * 200 * 6000
    best = np.argsort(-(q @ rows.T), axis=1)[:, :20]
    assert [sorted(-i for _, i in h) for h in heaps.held] == np.sort(best, axis=1).tolist()
