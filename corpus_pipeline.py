"""A corpus pipeline: toxicity, near-duplicates, repeats, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again
as the next stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import bpe, decontaminate, ngram_join, suffix_dedup, toxicity
from parlance.llm.frames import shared, table
from parlance.llm.language import held_out
from parlance.llm.queries import tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network calls toxic go.

    Null, empty and letterless texts have no window and score as the share of toxic training
    texts, so they stay unless most of those are toxic.  Of rows that share a doc_id all go if one
    is toxic, as they are one document; rows without a doc_id stay.  Other columns and their names
    don't matter; an empty table stays empty.
    """
    found = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels"), held_out(5, 0)))
    return _without(docs, found.where("predicted = 1"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that links connect, the one with the smallest doc_id stays.

    Null, empty and wordless texts are linked with nothing and stay.  Different texts under one
    doc_id are judged one by one, so that none goes but for a text that stays; repeated rows stay or
    go together; rows without a doc_id stay.
    """
    gone = ngram_join.similar_links(docs).where("doc_id <> text_id").select(F.col("doc_id").alias("gone"), F.col("text_hash").alias("of")).distinct()
    here = (docs["doc_id"] == gone["gone"]) & (F.xxhash64(docs["text"].cast("string")) == gone["of"])
    return docs.join(gone, here, "left_anti").select([docs[f"`{c}`"] for c in docs.columns])


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What repeats a document with a smaller id is cut out of the text; documents of which nothing is left go, those that had nothing to cut stay as they are.

    Each row keeps its own columns and what is left of its own text, also where rows share a
    doc_id; n_chars, if there, is counted anew.  Null and empty texts and rows without a doc_id
    stay as they are.  A cut within a character drops the rest of the character.
    """
    found = suffix_dedup.remove_repeats(docs, text=True, carry=True).where("n_removed = 0 or kept <> ''")
    kinds, cut = dict(docs.dtypes), F.col("n_removed") > 0
    changed = {"text": F.col("kept"), "n_chars": F.char_length("kept")}
    columns = []
    for k, c in enumerate(docs.columns):
        own = F.col(f"rest.c{k}")
        columns.append((F.when(cut, changed[c].cast(kinds[c])).otherwise(own) if c in changed else own).alias(c))
    return found.select(columns).union(docs.where(docs["doc_id"].isNull()))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Items without words are held by no document, nor do null and empty texts hold any.  Rows that
    share a doc_id go together if one holds an item; rows without a doc_id stay.
    """
    return _without(docs, decontaminate.contained_items(docs, table(spark, sf_dir, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token ids of each row that is left, with the digests of the ids and of the decoded text.

    Null and empty texts have no ids; repeated rows each give a row, rows without a doc_id too.
    """
    return bpe.round_trip(docs, tokenizer_file("word_bpe_49k.json"), out=("ids",))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose doc_id isn't among those of ``gone``; a null is among none."""
    ids = gone.select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(ids, docs["doc_id"] == ids["gone"], "left_anti").select([docs[f"`{c}`"] for c in docs.columns])


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("suffix_array_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: The stages learn a network and encode by merge ranks, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what they write goes to the shared folder that holds checkpoints, and goes once the next stage is written."""
    shared(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(done, True)
    return docs
