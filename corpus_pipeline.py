"""A training corpus from documents, in five stages; each is written as Parquet and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import mixing
from sparkloom.llm._shared import written
from sparkloom.llm.ngram_join import ngram_jaccard_join
from sparkloom.llm.pieces import encode_pieces
from sparkloom.llm.quality import quality_scores, train_quality
from sparkloom.llm.queries import tokenizer
from sparkloom.llm.secrets import redact_secrets

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _apart(docs: DataFrame, *names: str) -> DataFrame:
    """docs with its own columns of these names renamed out of an operator's way."""
    mark = "own"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    return docs.withColumnsRenamed({c: f"{mark}{c}" for c in docs.columns if c.lower() in names})


def _back(rows: DataFrame, marked: DataFrame, docs: DataFrame) -> DataFrame:
    """Only the columns of docs, by their own names again."""
    return rows.select(*(F.col(m).alias(c) for m, c in zip(marked.columns, docs.columns, strict=True)))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from labels, predicts to be of quality 1.

    Rows are judged one by one by their text: repeated rows go or stay
    together, null and empty texts are scored by the bias, columns named score
    or predicted stay docs' own.
    """
    model = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    marked = _apart(docs, "score", "predicted")
    return _back(quality_scores(marked, model).where("predicted = 1"), marked, docs)


def ngram_jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies; rows without doc_id stay.

    Null and blank texts are near no other and stay. Of rows that repeat a kept
    doc_id the one of the smallest text stays, then of the smallest other columns.
    """
    groups = ngram_jaccard_join(docs, count_links=False)
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    kept = docs.join(first, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", *others)).alias("at"))
    kept = kept.select("doc_id", *(F.col("at").getField(c).alias(c) for c in ("text", *others)))
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; null and empty texts stay, as do repeated rows and other columns."""
    return redact_secrets(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One epoch at most of each source, towards the target weights, within nine tenths of all tokens.

    Rows that repeat a doc_id are taken or left together; rows without doc_id
    are never taken; null languages and sources form leaves of their own.
    """
    weights = {f"mix_{level}": w for level, w in mixing.WEIGHTS.items()}
    marked = _apart(docs, "copies", "n_tokens", "mix_domain", "mix_lang", "mix_source", "whole", "last")
    mixed = mixing.mix_sources(marked, mixing.document_levels("mix_"), weights, num=9, den=10, epochs=1)
    return _back(mixed.where("copies > 0"), marked, docs)


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_chars, n_ids, ids, exact): token ids, and whether they decode to the text; none for null texts."""
    encoded = encode_pieces(docs, tokenizer("piece_bpe_32k.model"))
    return encoded.select("doc_id", "lang", "source", "n_chars", F.size("ids").alias("n_ids"), "ids", "exact")


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_stage),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", mixing_sources),
    ("SentencePiece encoding and decoding", sentence_pieces),
]

#: The stages' models and automata are beyond SQL; tests/llm holds a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
