"""Corpus pipeline: toxic documents go, one of each group of near copies stays, contaminated documents go, the rest is packed.

Counted as part of the llm subpackage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, jaccard, packing, toxicity
from quire.llm.base import Scratch
from quire.llm.queries import table, tokenizer

#: A document goes when it is likelier toxic than not.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below TOXIC; columns and rows are otherwise untouched."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.scores(docs, model, keep=tuple(docs.columns)).where(F.col("score") < TOXIC).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each component of five-word Jaccard similarity of 0.8 or more.

    Documents without words are no copies of one another, so each stays. Rows
    that repeat both id and text are one document. Ids that are no whole numbers
    come after those that are, null ids after all others, so such a document stays only if no other of its component has one.
    """
    number = F.col("doc_id").try_cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")
    order = F.coalesce(F.lpad(number.cast("string"), 20, "0"), F.concat(F.lit("~"), F.col("doc_id").cast("string")), F.lit("~~"))
    ident = F.concat(order, F.lit(" "), F.md5(F.coalesce("text", F.lit(""))))
    named = docs.withColumn("_ident", ident)
    groups = jaccard.join(named, Scratch(spark, "near-copies"), ident="_ident", n=5, percent=80)
    stay = groups.where(F.col("_ident") == F.col("component_id")).select("_ident").distinct()
    return named.join(stay, "_ident", "left_semi").dropDuplicates(["_ident"]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ten words of a benchmark item occurs."""
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), keep=tuple(docs.columns), size=10)
    return found.where(~F.col("contaminated")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of at most 2048 tokens."""
    return packing.pack(packing.cut(docs, tokenizer(), most=2048), Scratch(spark, "pack"), most=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: The first stage's scores are a fitted model's, which SQL can't state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
