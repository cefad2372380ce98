"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir) and returns rows that are written as Parquet and reread
as the next stage's docs; all but the last return the columns of documents.

1. toxicity: documents that score 0.5 or more go; the classifier learns from the labelled rows that are not held out.
2. near_duplicates: one document of each class stays, the one with the smallest doc_id.
3. repeated_passages: words covered by 50-word windows that start in an earlier document go; n_chars follows, and documents
   that lose all their words go.
4. decontamination: documents that overlap a benchmark item go.
5. mix: copies of documents by source weights, dealt into shards and shuffled within them: the columns of documents and
   copy, shard, size, source_size, target.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, mixing, near_dedup, substring_dedup, toxicity
from tidemark.llm.common import shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id")))
    return toxicity.clean(docs, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicated(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = [F.struct(*rest).alias("row")] if rest else []  # one column, so that no name clashes with the operator's
    out = substring_dedup.remove_repeats(docs.select("doc_id", "text", *row), keep_layout=True, carry=("row",) if rest else ())
    out = out.where("n_removed = 0 or n_removed < n_words")
    cut = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long"))
    columns = {"doc_id": F.col("doc_id"), "text": F.col("kept_text")} | {c: F.coalesce(cut, F.col(f"row.`{c}`")) if c == "n_chars" else F.col(f"row.`{c}`") for c in rest}
    return out.select(*(columns[c].alias(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs, carry=docs.columns)
    return mixing.draw(mixed).select(*[c for c in docs.columns if c not in mixing.OWN], "copy", "shard", "size", "source_size", "target")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("mix", mix_sources),
]

#: Learned scores and near-duplicate classes can't be told in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents; between stages, rows are written to the shared folder and reread.

    A stage's rows are deleted once the next stage's are written; those that the last one reads stay, with its result.
    """
    docs = table(spark, sf_dir, "documents")
    where = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{where}/{k}-{name}")
            docs = spark.read.parquet(f"{where}/{k}-{name}")
            if k:
                deleted(spark, f"{where}/{k - 1}-{STAGES[k - 1][0]}")
    return docs


def deleted(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
