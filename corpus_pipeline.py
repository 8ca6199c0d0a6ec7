"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
``run`` writes each result as Parquet in the cluster's shared folder and rereads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import mixing, packing, quality, secrets, simhash
from millrace.llm.common import discard, materialize, scoped

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go.

    Null and word-less texts go, as they have too few words; repeated rows share a
    verdict; rows without doc_id, lang or source are judged by their text alone.  An
    empty table gives an empty one; columns beyond those of documents are dropped.
    """
    return quality.verdicts(docs.select(*COLUMNS)).where(F.col("rejected_by").isNull()).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: that with the smallest doc_id, the first of equal ones.

    Groups are made of rows, not of ids, so a text whose doc_id is null or repeated
    stays unless it has a near copy, and of a repeated row one stays.  Null and
    word-less texts are near copies of each other.  An empty table gives an empty
    one; columns beyond those of documents are dropped.
    """
    rows = materialize(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()))
    found = simhash.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"))
    groups = found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("group")).join(rows.select("row", "doc_id"), "row")
    stay = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")).select(F.col("first.row").alias("row"))
    return rows.join(stay, "row", "left_semi").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; the documents stay.

    n_chars becomes the length of the masked text, null for null text.  Repeated
    rows are masked alike.  An empty table gives an empty one; columns beyond those
    of documents are dropped.
    """
    found = secrets.find_secrets(docs.select(*COLUMNS), secrets.train(docs), with_text=True)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, or left out, as the mix says.

    Null sources are one source; word-less documents keep a copy, as they change no
    sum; repeated rows are rows of their own.  An empty table gives an empty one;
    columns beyond those of documents are dropped.
    """
    mixed = mixing.mix(docs.select(*COLUMNS), with_rows=True).where(F.col("copies") > 0)
    return mixed.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all copies with their places in sequences of 2,048 tokens.

    Null text packs as its end alone; copies of a document have places of their own.
    An empty table gives an empty one.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scoped() as keep:  # what a stage has written on its way goes, as does its input
            after = keep(materialize(stage(spark, docs, sf_dir)))
        discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained models, hashes and tokenisers have no SQL form; tests/llm compares with a brute-force version.
ORACLE_SQL = None
