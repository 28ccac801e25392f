"""A training corpus from raw documents, stage by stage.

The table between two stages is `documents` as the stage before left it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsheet.llm import decontaminate, langid, lines, packing, simhash
from callsheet.llm.common import new_folder, remove_folder
from callsheet.llm.queries import TOKENIZER

#: Least posterior probability of a document's language.
MIN_SCORE = 0.5

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _with_text(docs: DataFrame, changed: DataFrame, text: str) -> DataFrame:
    """The columns of `docs`, which `changed` has in `row`, with a new text and its length."""
    return changed.select(
        *[
            F.col(text).alias(c)
            if c == "text"
            else F.length(text).cast(docs.schema[c].dataType).alias(c)
            if c == "n_chars"
            else F.col("row")[c].alias(c)
            for c in docs.columns
        ]
    )


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language stays open.

    A language stays open if the likeliest one has less than MIN_SCORE. The model learns
    from the rows outside the held-out fold.
    """
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.scored(docs, model)
    known = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_SCORE)
    return found.where(known).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that many documents share from all but one of them."""
    kept = lines.with_kept_lines(docs, lines.keep_bitmaps(docs))
    return _with_text(docs, kept, "kept_text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one with the smallest id."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the passages of benchmark items out, and documents that are mostly such passages."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    clean = decontaminate.remove_spans(docs, list(decontaminate.automata(items)))
    return _with_text(docs, clean, "clean_text")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences."""
    packed = packing.pack(packing.pieces(docs, TOKENIZER))
    return packed.withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: Language ID is a fitted model, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole `documents` table, each written and read again.

    What a stage wrote is removed once the next one has been written in full, so that one
    copy of the corpus is on the shared disk at the end, the one that the result is read from.
    """
    folder = new_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove_folder(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
