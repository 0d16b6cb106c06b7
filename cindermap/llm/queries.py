"""One query per operator over the driver tables, and the SQL that states the same result where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cindermap.llm import covertree, html, jaccard, licenses, lines, mixing, packing, periodic, phrases, rules, sharding, token_file, topk
from cindermap.llm.common import table
from cindermap.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

WORD_TOKENIZER, WORD_END = "word_bpe_49k.json", 2
BYTE_TOKENIZER, BYTE_END = "byte_bpe_50k.json", 0
WINDOW = 1024

# the mixture: domains by source, and weights among siblings of the tree; what is not named weighs 1
DOMAINS = {"web": ("src0", "src1", "src2", "src3"), "reference": ("src4", "src5", "src6", "src7", "src8"), "forum": ("src9", "src10", "src11", "src12", "src13")}
WEIGHTS = {"domain": {"web": 4, "reference": 5, "forum": 3, "other": 2}, "lang": {"en": 6, "de": 3, "fr": 3, "es": 2}, "source": {"src0": 3}}
LEVELS = ("domain", "lang", "source")
SHARE_PERCENT, MAX_EPOCHS, SEED = 80, 3, 17


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def with_domain(docs: DataFrame) -> DataFrame:
    domain = F.lit("other")
    for name, sources in DOMAINS.items():
        domain = F.when(F.col("source").isin(*sources), F.lit(name)).otherwise(domain)
    return docs.withColumn("domain", domain)


def tree_weights() -> dict:
    return {level: mixing.weight_of(level, WEIGHTS[level]) for level in LEVELS}


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_domain(table(spark, sf_dir, "documents"))
    return mixing.mix(docs, LEVELS, tree_weights(), SHARE_PERCENT, MAX_EPOCHS, SEED)


@query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents"), size=3, num=9, den=10)


@query
def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


@query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known_licenses(spark))


@query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    files = token_file.write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(WORD_TOKENIZER), WORD_END, leading_space=False)
    return token_file.read_token_files(files, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "text", F.char_length("text").cast("long").alias("n_chars"))


@query
def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), 20, F.col("vec_id") % 20 == 0)


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_TOKENIZER), WINDOW, BYTE_END)
    digested = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(digested, WINDOW)


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.quality(table(spark, sf_dir, "documents"), report=True)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def with_cycles(docs: DataFrame) -> DataFrame:
    """Every tenth document, by the checksum of its id, repeats a stretch of its words from some word on to the end; a null id stays as it is."""
    words = F.expr(r"regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 0)")
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")
    n = F.greatest(F.size(words), F.lit(1)).cast("long")
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
    cycle = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
    cycled = F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(cycle, F.lit(1), (n - a).cast("int")))
    return docs.withColumn("text", F.when(h % 10 == 0, F.array_join(cycled, " ")).otherwise(F.col("text")))


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_cycles(table(spark, sf_dir, "documents")))
    # greatest length, then smallest start, then smallest period
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    length = -longest["less"]
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        longest["start"].alias("start"),
        length.alias("length"),
        longest["period"].alias("period"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).withColumn("exponent_milli", F.expr("1000 * length div period"))


@query
def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_vectors(table(spark, sf_dir, "embeddings"), 95, 100)
