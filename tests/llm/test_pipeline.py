"""Each stage of the corpus pipeline on what the one before kept."""

import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from test_joins import near_duplicates, removed_by_hand
from test_text import check_packing
from tokenizers import Tokenizer

from tallyspark.llm import langid

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = dict(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").collect())
    before = {r["doc_id"]: r for r in docs.collect()}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs_before = docs
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if n < 4:
            assert docs.columns == COLUMNS
            after = {r["doc_id"]: r for r in docs.collect()}
        if name in ("toxicity", "language_id", "ngram_jaccard_join"):
            assert all(after[i] == before[i] for i in after)
        if name == "toxicity":
            gone = [i for i in before if i not in after and i in labels]
            assert sum(labels[i] for i in gone) >= 0.8 * len(gone)
            assert len(after) >= 0.8 * len(before)
        elif name == "language_id":
            assert set(after) == in_a_learned_language(docs_before)
        elif name == "ngram_jaccard_join":
            assert set(after) == {c for _, _, c in near_duplicates([(i, r["text"]) for i, r in before.items()])}
        elif name == "suffix_array_dedup":
            want = removed_by_hand([(i, r["text"]) for i, r in before.items()])
            assert set(after) == set(before)
            for i, r in after.items():
                assert r["n_chars"] == len(r["text"])
                if want[i][1] == 0:
                    assert r["text"] == before[i]["text"]
                elif "�" not in r["text"] and r["text"].isascii() and before[i]["text"].isascii():
                    assert hashlib.sha256(r["text"].encode()).hexdigest() == want[i][3]
        else:
            library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            library.no_padding()
            library.no_truncation()
            check_packing(docs.collect(), {i: [*library.encode(r["text"], add_special_tokens=False).ids, 0] for i, r in before.items()}, 1024)
        before = after


def in_a_learned_language(docs):
    """Ids of texts with letters whose best cosine with the prototypes is no lower than that of all but one in a thousand labelled texts."""
    rows = langid.identify(docs, langid.train(docs), keep=COLUMNS).collect()
    known = sorted(r["score"] for r in rows if r["lang"] is not None and len(r["text"] or "") >= 200)
    least = np.floor(1000 * known[int(0.001 * len(known))]) / 1000
    return {r["doc_id"] for r in rows if any(c.isalpha() for c in r["text"] or "") and (r["score"] >= least or len(r["text"]) < 200)}


def test_other_languages_go(spark, sf_dir):
    """Texts in languages that no label names, among labelled ones: the cosine tells, at every length that can be told."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(COLUMNS)
    other = [
        "Chłopiec szedł codziennie rano na stary targ kupić świeży chleb i trochę owoców, a potem wracał do domu. ",
        "Быстрая коричневая лиса перепрыгивает через ленивую собаку и бежит дальше по дороге к лесу. ",
        "Poika kulki joka aamu vanhalle torille ostamaan tuoretta leipää ja hedelmiä ja palasi sitten kotiin. ",
        "天地玄黃宇宙洪荒日月盈昃辰宿列張寒來暑往秋收冬藏閏餘成歲律呂調陽雲騰致雨露結為霜。",
    ]
    more = spark.createDataFrame([(10**6 + n, t * k, None, "s", len(t) * k) for n, (t, k) in enumerate((t, k) for t in other for k in (6, 40))] + [(10**7, "Pies", None, "s", 4)], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.keep_languages(spark, docs.union(more), sf_dir).collect()}
    assert {i for i in kept if i >= 10**6} == {10**7}
    with_letters = docs.where(docs.text.rlike(r"\p{L}")).count()
    assert len(kept) - 1 >= 0.99 * with_letters


def test_run_is_the_stages_in_order(spark, sf_dir, tmp_path):
    got = corpus_pipeline.run(spark, sf_dir)
    assert "sequence_id" in got.columns and got.count() > 0


def test_an_empty_corpus_passes_through(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_languages_without_a_label_keep_all_texts_with_letters(spark, sf_dir):
    rows = [(1, "the dog", None, "s", 7), (2, "12 !", None, "s", 4), (3, None, None, "s", 0), (4, "漢字", None, "s", 2), (None, "é", None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = corpus_pipeline.keep_languages(spark, docs, sf_dir).collect()
    assert {tuple(r) for r in got} == {tuple(rows[k]) for k in (0, 3, 4)}


def test_a_stage_begins_with_memory_given_back(spark, sf_dir):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = lambda: sum(b.getCollectionCount() for b in beans if any(x in b.getName() for x in ("Old", "MarkSweep")))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = whole()
    corpus_pipeline.pack(spark, docs, sf_dir)
    assert whole() > before
