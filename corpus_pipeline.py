"""The corpus pipeline: five stages over ``documents``, each an operator of ``tallyspark.llm``.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept.
Documents that the toxicity model marks go; then those in no language that was
learned, as their cosines tell; then all but one document of each near-duplicate group; then strings
of 50 bytes that an earlier document has are cut out; what is left is packed.

All but the last return the columns of ``documents``.  Rows with a null id are
kept where nothing decides against them; an empty table passes through empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import langid, ngram_join, packing, suffix_dedup, toxicity
from tallyspark.llm.queries import TOKENIZER, table
from tallyspark.llm.shared import Workspace, release_executors

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def begin(spark: SparkSession) -> None:
    """Executors begin a stage without the heap that the one before has stretched.

    Whole texts go to the workers 2 MB at a time: a task holds a batch on either side, and its buffers are twice as large."""
    release_executors(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "2m")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not mark."""
    begin(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=COLUMNS).where("predicted = 0").select(COLUMNS)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language: those below the cosine that labelled texts reach go, and those without a letter.

    Texts under 200 characters are too short to tell. Without a labelled text all others stay.
    """
    begin(spark)
    prototypes = langid.train(docs)
    if not prototypes:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(COLUMNS)
    scored = Workspace(spark).saved(langid.identify(docs, prototypes, keep=COLUMNS))  # read for the bound, and again by it
    return langid.recognised(scored, langid.least_cosine(scored)).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that whose id names the component. Of rows with its id all unlike ones stay."""
    begin(spark)
    kept = ngram_join.join(docs).where("component_id = doc_id").groupBy("doc_id").agg(F.count("*").alias("rows"))
    found = docs.join(kept, "doc_id")
    # rows with one id are one document; only where an id has several are repeated rows looked for
    once = found.where("rows = 1").select(COLUMNS)
    several = found.where("rows > 1").select(COLUMNS).distinct()
    return once.union(several).union(docs.where("doc_id is null").select(COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that an earlier document has; a letter cut in two goes with them."""
    begin(spark)
    left = suffix_dedup.remove_repeats(docs, keep=COLUMNS[2:], as_text=True)
    return left.withColumn("text", F.col("kept")).withColumn("n_chars", F.char_length("kept").cast("long")).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens in sequences of balanced cost."""
    begin(spark)
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_languages),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("packing", pack),
]

#: Models, the tokenizer and packing are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, work = table(spark, sf_dir, "documents"), Workspace(spark)
    for _, stage in STAGES[:-1]:
        docs = work.saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
