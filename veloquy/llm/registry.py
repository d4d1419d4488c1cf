"""The queries of this subpackage over the documents table, and SQL for those it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toxicity
from .brown_lm import brown_scores
from .common import crc_mod, documents
from .divergence import divergence
from .fingerprints import fingerprints
from .labelled import joined_sample, label_share, labelled_sample
from .language_id import fit_language, with_language
from .mixing import mixed
from .near_dup import near_duplicates
from .oracles import ORACLES as ORACLES
from .pieces import with_decoded, with_pieces
from .pii import pseudonymised
from .quality_classifier import THRESHOLD, fit_quality, quality_scores
from .quality_rules import COVERAGE_LIMITS, quality_rules
from .token_counts import with_budget
from .toxicity import fit_toxicity, with_score
from .vector_codes import compressed

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def labels_of(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", label)


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = crc_mod("doc_id", 3) == 1
    sample = labelled_sample(docs.filter(~held_out), "doc_id", "text", "lang")
    found = with_language(docs.select("doc_id", "text"), fit_language(sample["text"].tolist(), sample["label"].tolist()))
    return found.select("doc_id", held_out.alias("held_out"), "language.lang_pred", "language.score", F.size("language.spans").alias("n_spans"))


@query
def op2_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_scores(documents(spark, sf_dir), crc_mod("doc_id", 7) == 2)


#: Pseudonyms made with another key can't be linked with these; production passes its own.
PSEUDONYM_KEY = "documents-v1"
WORD_MODEL = "file:///opt/tokenizers/word_bpe_49k.json"
TOKEN_LIMIT = 2048
PIECE_MODEL = "file:///opt/tokenizers/piece_bpe_32k.model"


@query
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixed(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return found.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.repeats")).alias("taken"), F.col("mix.repeats").alias("repeats"))


@query
def op4_consistent_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))


@query
def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonymised(documents(spark, sf_dir).select("doc_id", "text"), PSEUDONYM_KEY)
    return found.select("doc_id", "text", F.size("pii").alias("n_replaced"), F.array_sort(F.array_distinct(F.transform("pii", lambda x: x.kind))).alias("kinds"))


def piece_model(spark: SparkSession, path: str = PIECE_MODEL) -> bytes:
    """The model file's bytes, read by Spark, so that the path may be in any store it knows."""
    found = spark.read.format("binaryFile").load(path).select("content").first()
    return bytes(found.content)


@query
def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and whether decoding them gives the text back."""
    model = piece_model(spark)
    found = with_decoded(with_pieces(documents(spark, sf_dir).select("doc_id", "text"), model), model)
    return found.select("doc_id", F.size("pieces").alias("n_pieces"), "pieces", F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(documents(spark, sf_dir).select("doc_id", "text"))
    m = lambda x: F.col(f"measures.{x}")
    shown = [m(x).alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", "line_chars")]
    return found.select("doc_id", *shown, *[m(f"dup_chars_{n}").alias(f"dup_chars_{n}") for n in COVERAGE_LIMITS], "base_failed", "kept")


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = labels_of(spark, sf_dir, "toxic").filter(crc_mod("doc_id", 5) != 0)
    sample = joined_sample(documents(spark, sf_dir), train, "doc_id", "text", "toxic", toxicity.ROWS_A_LABEL, toxicity.SAMPLE_CHARS)
    model = fit_toxicity(sample["text"].tolist(), sample["label"].to_numpy(), label_share(train, "toxic"))
    found = with_score(documents(spark, sf_dir).select("doc_id", "text"), model)
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op9_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = labels_of(spark, sf_dir, "quality").filter(crc_mod("doc_id", 4) != 2)
    sample = joined_sample(documents(spark, sf_dir), train, "doc_id", "text", "quality")
    share = label_share(train, "quality")
    model = fit_quality(sample["text"].tolist(), sample["label"].to_numpy(), share)
    found = quality_scores(documents(spark, sf_dir).select("doc_id", "text"), model, train.filter("quality is not null"), share)
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@query
def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(documents(spark, sf_dir))


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text, and the code points of its longest prefix within the limit."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = with_budget(docs, piece_model(spark, WORD_MODEL), TOKEN_LIMIT)
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return found.select("doc_id", n_bytes.alias("n_bytes"), "tokens.n_tokens", (F.col("tokens.n_tokens") > TOKEN_LIMIT).alias("over_limit"), F.col("tokens.fits").alias("fits"))
