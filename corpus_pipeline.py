"""The corpus pipeline: language ID, exact deduplication, near deduplication, mixing, packing.

Each stage is (name, function of (spark, docs, sf_dir)); its result is written as Parquet and read again as the next
stage's docs. Every stage works on all rows that its predecessor kept; all but the last return the columns
of docs.

1. ``language_id`` drops texts without a letter and those whose windows agree on no language (a score under LEAST_SCORE,
   little over chance). It learns from docs; if they teach nothing, none has a language.
2. ``exact_dedup`` keeps one row of equal texts, that with the largest doc_id.
3. ``jaccard_dedup`` keeps one row of each group of near duplicates (shingles of 5 words, similarity 0.8 or more),
   that with the smallest doc_id.
4. ``mix_sources`` takes documents to the sources' target weights, some twice, in order of training position.
5. ``pack_sequences`` gives the packing plan, one row for each piece; a document taken twice is packed twice.

A run with a run_id that was begun before on the same documents, in this application or another, goes on after its last whole stage.

Decisions are brought back by doc_id and a hash of the text, nulls included, so rows that share an id but not
the text are decided apart, and of rows that repeat both, one goes on. Rows to drop are broadcast up to
BROADCAST_ROWS of them (counted first), else joined by a shuffle. Empty docs give an empty result of the same columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import checkpoint_setting, cut, fingerprint, fresh, ship, table
from tallyframe.llm.exact_dedup import exact_dedup
from tallyframe.llm.language_id import UND, annotate
from tallyframe.llm.mixing import schedule
from tallyframe.llm.near_dup import near_duplicates
from tallyframe.llm.packing import pack

LEAST_SCORE = 0.3
WORDS, PERCENT = 5, 80
BROADCAST_ROWS = 250_000


def _kept(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of docs that decided (doc_id, fp, kept) keeps."""
    keys = cut(decided.groupBy("doc_id", "fp").agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("n")))
    gone = keys.where("not kept").select(F.struct("doc_id", "fp").alias(fresh(docs, "gone")))
    name = gone.columns[0]
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    mark = fresh(docs, "fp")
    rows = docs.withColumn(mark, fingerprint(F.col("text")))
    rows = rows.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(f"{name}.doc_id")) & (F.col(mark) == F.col(f"{name}.fp")), "left_anti")
    if keys.where("kept and n > 1").limit(1).count():
        rows = rows.dropDuplicates(["doc_id", mark])
    return rows.select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    lang, score = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    found = annotate(docs, lang, score)
    return found.where((F.col(lang) != UND) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return _kept(docs, exact_dedup(docs))


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return _kept(docs, near_duplicates(docs, WORDS, PERCENT))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return schedule(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("jaccard_dedup", jaccard),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Neither the network of stage 1 nor the tokenizer of stage 5 is SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _path(spark: SparkSession, name: str):
    """A path and its file system, on the JVM's side."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def run(spark: SparkSession, sf_dir: str, run_id: str | None = None) -> DataFrame:
    """All stages over documents. Each result is written to the shared folder; once the next is written it goes, the last one stays."""
    folder = f"{checkpoint_setting(spark)}/pipeline-{run_id or uuid.uuid4().hex}"
    paths = [f"{folder}/{k}-{name}" for k, (name, _) in enumerate(STAGES)]
    whole = [k for k, p in enumerate(paths) for path, files in [_path(spark, f"{p}/_SUCCESS")] if files.exists(path)]
    done = max(whole, default=-1)
    docs = spark.read.parquet(paths[done]) if whole else table(spark, sf_dir, "documents")
    for k, (_, stage) in list(enumerate(STAGES))[done + 1 :]:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(paths[k])
        docs = spark.read.parquet(paths[k])
        for before in paths[:k]:
            path, files = _path(spark, before)
            files.delete(path, True)
    return docs
