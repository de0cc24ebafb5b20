"""A pipeline from raw documents to token ids: five stages, each calling one operator of glyphtrace.llm.

Each stage reads what the stage before it wrote (Parquet, with the columns of documents) and works on all of it:
languages that can't be told go, of equal texts one stays, of near-duplicates one stays, sources are mixed to their
target weights (a row for each pass over it; the one row of a source at its cut has only the words up to the cut),
and what is left is encoded.

Cases, for every stage: a null text counts as empty, and texts without words, which have no language to tell, go with
the first stage; null ids, sources and languages are values like others; repeated rows are copies, of which one stays;
texts of any length are read whole; of equal candidates the one with the smallest id, then digest, stays; an empty
table gives an empty one; columns other than those of documents are not carried on, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphtrace.llm import byte_bpe, exact_dedup, language_id, minhash, mixing
from glyphtrace.llm.common import cut, fold, ranked, shared_dir, sized

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose language is rejected."""
    model = language_id.fit(docs.where(fold(F.col("doc_id"), 3) != 1))
    return language_id.predicted(docs.select(*COLUMNS), model).where("NOT rejected").select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_copies(docs.select(*COLUMNS))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, and all that are in no group.

    Rows are told by id and text, so an id on two texts and rows without an id are judged by themselves.
    """
    return minhash.drop_near_copies(docs.select(*COLUMNS)).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    rows = docs.select(*COLUMNS)
    key = F.struct("doc_id", "source", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))
    taken = cut(mixing.mix(rows).select(F.struct("doc_id", "source", "text_md5").alias("key"), "size", "taken"))
    # equal rows share what is taken of them: the first ones take as much as a row may, by their number
    plan = cut(taken.groupBy("key", "size").agg(F.sum("taken").alias("taken"), F.count("*").alias("n")).where("taken > 0"))
    most = mixing.MOST * F.col("size")
    met = rows.withColumn("own", key).join(sized(plan), F.col("own") == F.col("key"))
    numbered = met.where("n = 1").drop("key").withColumn("slot", F.lit(0).cast("long"))
    if plan.where("n > 1").limit(1).count():
        numbered = numbered.unionByName(ranked(met.where("n > 1").drop("key"), ["own"], ["size"]))
    met = numbered.withColumn("taken", F.least(most, F.col("taken") - F.col("slot") * most)).where("taken > 0")
    passes = F.ceil(F.col("taken") / F.col("size")).cast("int")  # at most MOST
    each = met.withColumn("_pass", F.explode(F.sequence(F.lit(1), passes)))
    words = F.least(F.col("size"), F.col("taken") - (F.col("_pass") - 1) * F.col("size"))
    whole = words == F.col("size")
    pattern = F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), words.cast("string"), F.lit("}+"))
    head = F.call_function("regexp_extract", F.col("text"), pattern, F.lit(0))
    return each.withColumn("text", F.when(whole, F.col("text")).otherwise(head)).withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language_id", by_language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixed), ("byte_bpe", encoded)]

#: Language identification learns a model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table documents of sf_dir, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
    return docs
