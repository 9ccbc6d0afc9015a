"""From documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; a stage's rows
are written as Parquet and read again as the next one's docs.  All but the
last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import decontamination, jaccard, language_id, packing, secrets
from logloom.llm.queries import learned_languages, vocabulary
from logloom.llm.shared import read_table, shared_dir, working_tables

#: SQL can't express cross-parsing, Jaccard components, a trained forest or packing in one statement.
ORACLE_SQL: str | None = None


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no learned language (no letters, or no text).

    Rows that repeat each stay or go alike; where no document has a lang,
    nothing can be learned and every document with a letter stays.
    """
    return language_id.only_identified(docs, learned_languages(docs))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest doc_id, of each group linked by similarity 0.8 of 5-word shingles.

    It goes by row: rows with one doc_id and different texts are different
    documents, and of rows that repeat one stays.  Texts without words and
    nulls link with nothing and stay; a null doc_id comes last.  An empty
    table stays empty.
    """
    return jaccard.keep_one(docs, size=5, num=4, den=5)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that benchmark items contaminate.

    Null and wordless texts and all others without a hit stay; with an empty
    table benchmark all stay.
    """
    return decontamination.only_clean(docs, read_table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; every document stays, n_chars follows the text (null for a null text)."""
    clean = secrets.redact(docs, secrets.train(secrets.labelled_findings(spark)))
    return clean.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences: one row for each piece.

    A null or empty text is one piece of one token; rows that repeat are
    packed each; an empty table gives no rows.
    """
    return packing.pack(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identified),
    ("ngram_jaccard_join", deduplicated),
    ("benchmark_decontamination", decontaminated),
    ("secret_scans", redacted),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the table documents; each one's rows are written and reread by the next."""
    docs = read_table(spark, sf_dir, "documents")
    base = shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{base}/{k}_{name}"
        with working_tables(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
