"""A corpus pipeline of the training-data operators; each stage reads all that the one before it kept.

Between stages the rows are written as Parquet to the shared folder and read again. All but the last stage return the columns
of ``documents``, whatever they are called; the last returns the mix.

Defined results. Rows with a null or empty text, a null source or a null doc_id go through every stage by the same rules: the classifier
scores an empty text as such; a text that loses all its words to line dedup goes, one that had none stays. Rows equal in
doc_id and text count as one document: one of them leaves the Jaccard stage, where of each group of near copies the smallest doc_id stays. Empty
tables give empty results; without labels of both kinds all documents have one score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import classifier, decontamination, jaccard, lines, mixing
from tidemill.llm.common import Scratch, cut, table

#: Near-duplicate documents: five words a shingle, a similarity of 0.8 or more.
SHINGLE, PERCENT = 5, 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = classifier.train(docs, table(spark, sf_dir, "labels"))
    scored = classifier.score(docs, model, keep=True)
    name = scored.columns[-1]
    return scored.where(F.col(name) >= classifier.THRESHOLD).drop(name)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that nearly repeat one elsewhere; n_chars follows the text. Those that lose all their words go."""
    _, removed = lines.result_names(docs.columns)
    whole = F.size(removed) == 0
    rows = lines.dedup_lines(docs, exact=True).where(whole | F.col("text").rlike(r"[\p{L}\p{N}]"))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return rows.select(*[f"`{c}`" for c in docs.columns])


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.one_of_each(docs, SHINGLE, PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window stands."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.pareto_mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [("quality", keep_quality), ("line_dedup", dedup_lines), ("jaccard", dedup_documents), ("decontamination", decontaminate), ("mixing", mix)]
ORACLE_SQL = None  # the classifier is no SQL; tests compare the pipeline with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for k, (_, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            docs = scratch.keep(docs) if k < len(STAGES) - 1 else cut(docs)
    return docs
