"""The registered queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import block_ann, bpe, html_text, langid, merkle, ngram_join, packing, pq_dedup, suffix_dedup, tandem, topk, toxicity, urls

TOKENIZER = "byte_bpe_50k.json"
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), with_ids=False)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def fold(n: int):
    """crc32 of the id as text, mod n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prototypes = langid.train(docs.where(fold(3) != 1))
    found = langid.identify(docs, prototypes)
    return found.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), decoded=True)
    return tokens.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pq_dedup.link(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages"), listed).drop("url")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(fold(4) != 2))
    found = toxicity.score(docs, model)
    return found.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_block_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.when(fold(7) == 0, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars"))
    found = merkle.manifest(table(spark, sf_dir, "documents"), tampered={"n_chars": more})
    refolded = found.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), merkle.folded(F.col("forged"), F.col("path")).alias("folded_root"))
    return refolded.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, n = F.crc32(F.col("doc_id").cast("string").cast("binary")), F.size("words")
    g = F.floor(h / 10)
    a = F.expr("cast(g % n as int)")
    planted = F.transform("words", lambda w, i: F.when(i >= F.col("a"), F.element_at("words", F.col("a") + (i - F.col("a")) % F.col("p") + 1)).otherwise(w))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", h.alias("h"), g.alias("g"))
    chosen = docs.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))).withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, a))
    chosen = chosen.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    found = tandem.find_runs(chosen.select("doc_id", F.when(F.col("n") > 0, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    ended = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(ended, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


OP8_SQL = """
WITH rules(host, path, verdict) AS (VALUES {values}),
parts AS (
  SELECT page_id, row_number() OVER () AS n,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
fits AS (
  SELECT p.*, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.n ORDER BY length(r.host) + length(r.path) DESC, length(r.host) DESC) AS place
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE place = 1
""".format(values=", ".join(map(str, RULES)))

#: Positions count from 0; a text's bytes are its pairs of hexadecimal digits.
OP2_SQL = """
WITH texts AS (SELECT row_number() OVER () AS n, doc_id, hex(coalesce(text, '')) AS h FROM documents),
parts AS (
  SELECT n, doc_id, start, substr(h, 2 * start + 1, 698) AS part FROM (SELECT *, unnest(range(0, length(h) // 2 - 49, 300)) AS start FROM texts)),
strings AS (
  SELECT n, doc_id, p, min(doc_id) OVER (PARTITION BY s) AS earliest
  FROM (SELECT n, doc_id, start + j AS p, substr(part, 2 * j + 1, 100) AS s FROM (SELECT *, unnest(range(length(part) // 2 - 49)) AS j FROM parts))),
begun AS (SELECT n, p, coalesce(p - lag(p) OVER (PARTITION BY n ORDER BY p) > 50, true) AS new FROM strings WHERE earliest < doc_id),
numbered AS (SELECT n, p, sum(new::INT) OVER (PARTITION BY n ORDER BY p) AS run FROM begun),
spans AS (SELECT n, min(p) AS a, max(p) + 50 AS b FROM numbered GROUP BY n, run),
between_ AS (SELECT n, a, b, coalesce(lag(b) OVER (PARTITION BY n ORDER BY a), 0) AS before FROM spans),
cuts AS (
  SELECT n, sum(b - a)::BIGINT AS removed, count(*) AS spans, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
  FROM between_ JOIN texts USING (n) GROUP BY n)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM texts LEFT JOIN cuts USING (n)
"""

#: Of distinct sets, then of all rows that have them.
OP4_SQL = """
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
words AS (SELECT k, doc_id, len(w) AS size, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM texts),
shingles AS (
  SELECT k, doc_id, size, i, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS g
  FROM words WINDOW o AS (PARTITION BY k ORDER BY i)),
sets AS (SELECT k, doc_id, list_sort(list(DISTINCT g)) AS s FROM shingles WHERE i <= greatest(size - 4, 1) GROUP BY k, doc_id),
classes AS (SELECT s, min(doc_id) AS rep, row_number() OVER () AS c, len(s) AS n FROM sets WHERE doc_id IS NOT NULL GROUP BY s),
grams AS (SELECT c, n, unnest(s) AS g FROM classes),
met AS (SELECT a.c AS a, b.c AS b, a.n AS n, b.n AS m, count(*) AS common FROM grams a JOIN grams b ON a.g = b.g AND a.c < b.c GROUP BY ALL),
close AS (SELECT a, b FROM met WHERE 100 * common >= 75 * (n + m - common)),
names AS (SELECT DISTINCT doc_id, c FROM sets JOIN classes USING (s) WHERE doc_id IS NOT NULL),
links AS (
  SELECT a, b FROM close UNION SELECT b, a FROM close
  UNION SELECT x.c, y.c FROM names x JOIN names y ON x.doc_id = y.doc_id AND x.c <> y.c),
reached AS (SELECT c AS a, c AS b FROM classes UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
least AS (SELECT r.a AS c, min(k.rep) AS component FROM reached r JOIN classes k ON k.c = r.b GROUP BY r.a),
known AS (SELECT doc_id, min(component) AS component FROM names JOIN least USING (c) GROUP BY doc_id)
SELECT t.doc_id, coalesce(len(s), 0) AS n_shingles, coalesce(component, t.doc_id) AS component_id
FROM texts t LEFT JOIN sets USING (k) LEFT JOIN known ON known.doc_id = t.doc_id
"""

#: Of distinct vectors, then of all rows that have them.
OP7_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
classes AS (SELECT v, min(vec_id) AS rep, count(*) AS copies FROM good GROUP BY v),
scaled AS (SELECT rep, copies, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM classes),
links AS (SELECT a.rep AS a, b.rep AS b, b.copies AS n FROM scaled a JOIN scaled b ON a.rep <> b.rep AND len(a.u) = len(b.u) AND list_sum(list_transform(range(1, len(a.u) + 1), lambda i: a.u[i] * b.u[i])) >= 0.95),
reached AS (SELECT rep AS a, rep AS b FROM scaled UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
known AS (
  SELECT c.v, c.copies - 1 + coalesce((SELECT sum(n) FROM links l WHERE l.a = c.rep), 0) AS n_links, (SELECT min(b) FROM reached r WHERE r.a = c.rep) AS component_id FROM classes c)
SELECT g.vec_id, k.n_links::BIGINT AS n_links, k.component_id, g.vec_id = k.component_id AS kept FROM good g JOIN known k USING (v)
UNION ALL SELECT vec_id, 0, vec_id, vec_id IS NOT NULL FROM embeddings WHERE vec_id IS NULL OR vec_id NOT IN (SELECT vec_id FROM good)
"""

OP10_SQL = """
WITH whole AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

OP11_SQL = """
WITH good AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]), lambda x, y: x + y, 0::DOUBLE) AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

#: CRC-32 of a number's digits, bit by bit.
CRC32 = """xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
    lambda c, b: list_reduce(range(8), lambda s, i: xor(s >> 1, CASE WHEN s & 1 = 1 THEN 3988292384 ELSE 0 END), xor(c, b)), 4294967295), 4294967295)"""

#: Nodes of all heights by a recursive query, then each row's siblings by its rank.
OP12_SQL = """
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS k, *, CASE WHEN {crc} % 7 = 0 THEN n_chars::HUGEINT + 1 ELSE n_chars END AS more FROM documents),
leaves AS (
  SELECT k, doc_id, lang, sha256({before} || {n_chars} || {text}) AS leaf, sha256({before} || {more} || {text}) AS forged FROM docs),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
nodes AS (
  SELECT lang, 0 AS h, i, n, leaf AS node FROM ranked
  UNION ALL
  SELECT lang, h + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(node, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY lang, h, i // 2),
subroots AS (
  SELECT lang, node, row_number() OVER (ORDER BY lang NOTNULL, encode(lang)) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS h, i, n, node FROM subroots
  UNION ALL
  SELECT h + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(node, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY h, i // 2),
beside AS (
  SELECT r.k, m.h, s.node AS digest, (s.i < m.i) AS is_left
  FROM ranked r JOIN nodes m ON m.lang IS NOT DISTINCT FROM r.lang AND m.i = r.i >> m.h AND m.n > 1
  LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM m.lang AND s.h = m.h AND s.i = xor(m.i, 1)
  UNION ALL
  SELECT r.k, 1000 + m.h, s.node, (s.i < m.i)
  FROM ranked r JOIN subroots g ON g.lang IS NOT DISTINCT FROM r.lang JOIN tops m ON m.i = g.i >> m.h AND m.n > 1
  LEFT JOIN tops s ON s.h = m.h AND s.i = xor(m.i, 1)),
paths AS (SELECT k, list({{'d': coalesce(digest, ''), 'l': coalesce(is_left, false)}} ORDER BY h) AS path FROM beside GROUP BY k),
folds AS (
  SELECT r.*, coalesce(array_to_string(list_transform(path, lambda s: s.d), ''), '') AS proof,
    list_reduce(list_prepend({{'d': forged, 'l': false}}, coalesce(path, [])),
      lambda a, s: {{'d': sha256(CASE WHEN s.l THEN s.d || a.d ELSE a.d || s.d END), 'l': false}}).d AS folded_root
  FROM ranked r LEFT JOIN paths USING (k))
SELECT f.doc_id, f.leaf, g.node AS subroot, t.node AS root, sha256(proof) AS proof_sha256, folded_root, folded_root = t.node AS verified
FROM folds f JOIN subroots g ON g.lang IS NOT DISTINCT FROM f.lang, (SELECT node FROM tops WHERE n = 1) t
""".format(
    crc=CRC32,
    before=" || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang")),
    **{c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("n_chars", "more", "text")},
)

#: Stretches where a word equals the one a period later, of all periods; those that a divisor of the period has too are no runs of it.
OP13_SQL = """
WITH hashed AS (SELECT row_number() OVER () AS k, doc_id, {crc} AS h, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
placed AS (SELECT *, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM hashed),
texts AS (
  SELECT k, doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(len(w)), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (len(w) - a) // (3 + (h // 10) % 8)) END]) END AS w FROM placed),
words AS (SELECT k, len(w) AS n, unnest(w) AS x, unnest(range(len(w))) AS i FROM texts),
often AS (SELECT *, count(*) OVER (PARTITION BY k, x) AS c FROM words QUALIFY c >= 4),
same AS (SELECT a.k, b.i - a.i AS q, a.i FROM often a JOIN often b ON a.k = b.k AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
islands AS (SELECT k, q, i, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS island FROM same),
stretches AS (SELECT k, q AS period, min(i) AS start, count(*) + q AS length FROM islands GROUP BY k, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (
  SELECT * FROM stretches s WHERE NOT EXISTS (
    SELECT 1 FROM stretches r WHERE r.k = s.k AND r.period < s.period AND r.start <= s.start AND r.start + r.length >= s.start + s.length)),
best AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY length DESC, start, period) AS place, count(*) OVER (PARTITION BY k) AS n_runs FROM runs),
lines AS (SELECT k, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS text FROM runs GROUP BY k),
gone AS (SELECT k, list(DISTINCT i) AS gone FROM (SELECT k, unnest(range(start + period, start + length)) AS i FROM runs) GROUP BY k)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(lines.text, '')) AS runs_sha256,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE [w[i + 1] FOR i IN range(len(w)) IF NOT list_contains(gone, i)] END, ' '), '')) AS collapsed_sha256
FROM texts LEFT JOIN (SELECT * FROM best WHERE place = 1) b USING (k) LEFT JOIN lines USING (k) LEFT JOIN gone USING (k)
""".format(crc=CRC32)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_pack": op1_pack, "op2_suffix_dedup": op2_suffix_dedup, "op3_langid": op3_langid, "op4_ngram_join": op4_ngram_join, "op5_html": op5_html, "op6_bpe": op6_bpe, "op7_embeddings": op7_embeddings, "op8_urls": op8_urls, "op9_toxicity": op9_toxicity, "op10_topk": op10_topk, "op11_block_ann": op11_block_ann, "op12_manifest": op12_manifest, "op13_runs": op13_runs}


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_dedup": OP2_SQL, "op4_ngram_join": OP4_SQL, "op7_embeddings": OP7_SQL, "op8_urls": OP8_SQL, "op10_topk": OP10_SQL, "op11_block_ann": OP11_SQL, "op12_manifest": OP12_SQL, "op13_runs": OP13_SQL}
