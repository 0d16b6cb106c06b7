"""From documents to packed training sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cindermap.llm import jaccard, lines, mixing, packing, rules
from cindermap.llm.queries import BYTE_END, BYTE_TOKENIZER, LEVELS, SEED, WINDOW, tree_weights, with_domain
from cindermap.session import materialize

MIX_PERCENT = 80  # of the tokens that are left


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number of its own for each row, in a written table: ids can be null and repeat."""
    return materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered", "zstd")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; a null or empty text has no words and goes. No rows give no rows."""
    return rules.quality(docs, carry=docs.columns).filter("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; n_chars follows the text.

    All rows stay, those with a null text as they are; copies of a text keep the lines of the first of them. No rows give no rows.
    """
    kept = lines.dedup_lines(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share 0.8 or more of their five-word shingles, one: the one with the smallest id.

    Rows are told apart by their place, not by their id: of rows with one id the first one stays, a null id comes after all others. A
    document without words is not part of a group and stays. No rows give no rows.
    """
    rows = _numbered(docs)
    classes = jaccard.similar(rows, size=5, num=8, den=10, key="__row").filter("n_shingles > 0").select(F.col("doc_id").alias("__row"), F.col("component_id").alias("group"))
    classes = materialize(classes, "classes")
    # groups of two or more hold a row that is not their first
    shared = classes.filter(F.col("__row") != F.col("group")).select("group").distinct()
    members = materialize(classes.join(shared, "group"), "members").join(rows.select("__row", "doc_id"), "__row")
    first = members.groupBy("group").agg(F.min_by("__row", F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).alias("__kept"))
    gone = members.select("__row", "group").join(materialize(first, "firsts"), "group").filter(F.col("__row") != F.col("__kept")).select(F.col("__row").alias("__gone"))
    return rows.join(gone.hint("merge"), F.col("__row") == F.col("__gone"), "left_anti").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the target weights of the tree; each row is taken once at most, so no copies come back.

    Null and empty texts and those without words have no tokens and are not taken; null languages and sources are categories. No rows
    give no rows.
    """
    rows = _numbered(docs)
    taken = mixing.mix(with_domain(rows), LEVELS, tree_weights(), MIX_PERCENT, 1, SEED, carry=["__row"]).select(F.col("__row").alias("__taken"))
    return rows.join(materialize(taken, "taken").hint("merge"), F.col("__row") == F.col("__taken"), "left_semi").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens and their places in sequences of at most ``WINDOW`` tokens.

    A null or empty text is its end id alone; repeated rows each have their pieces. No rows give no rows.
    """
    pieces = packing.token_pieces(docs, public_tokenizers.path(BYTE_TOKENIZER), WINDOW, BYTE_END)
    return packing.pack(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"), WINDOW)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixture),
    ("packing", packed),
]

#: Tokens are not for SQL; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each stage's rows are written before the next one reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
