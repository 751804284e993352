"""Documents to packed training sequences: five stages, each written as Parquet in the shared folder and read again.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the
columns of docs, extra ones too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.llm import quality
from barwright.llm.common import small_join, stored
from barwright.llm.decontamination import decontaminate
from barwright.llm.line_dedup import dedup_lines
from barwright.llm.near_dedup import near_duplicates
from barwright.llm.packing import pack
from barwright.llm.queries import END_ID, SEQUENCE, quality_model, read, tokenizer_path

#: Documents that score lower are rejected.
LEAST_QUALITY = 0.7
#: Documents whose sets of word shingles are as alike as this, in percent, are near duplicates.
LEAST_LIKENESS = 80

#: The stages learn a model, tokenize and follow chains of links, which SQL cannot express.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of at least LEAST_QUALITY, under a model learned from those with labels."""
    scored = quality.score(docs, quality_model(spark, docs, sf_dir), "__score")
    return scored.where(F.col("__score") >= LEAST_QUALITY).drop("__score")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that other documents hold too; null texts stay null."""
    cut = dedup_lines(docs, into="__lines")
    text = F.when(F.col("text").isNotNull(), F.col("__lines.kept"))
    cut = cut.withColumn("text", text)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("__lines.n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id; of rows that repeat it, one.

    A row goes or stays by its doc_id and text together: another text under the same id has its own fate.
    """
    key = ["doc_id", "__text_hash"]
    found = stored(near_duplicates(docs.select("doc_id", "text"), percent=LEAST_LIKENESS).withColumnRenamed("text_hash", "__text_hash"), "near")
    # Groups of which several rows would stay: rows that repeat one document, or two texts of one id that are alike.
    kept = found.where("kept and root is not null")
    twice = stored(kept.groupBy("root").agg(F.count("*").alias("n"), F.min("__text_hash").alias("first")).where("n > 1"), "twice")
    spare = small_join(kept, twice.select("root", "first"), ["root"]).where("__text_hash <> first").select(*key)
    marked = docs.withColumn("__text_hash", F.xxhash64("text"))
    gone = stored(found.where("not kept").select(*key).unionByName(spare).distinct(), "removed")
    rest = small_join(marked, gone, key, "left_anti")
    if twice.limit(1).count():
        doubled = stored(small_join(kept, twice.select("root"), ["root"], "left_semi").select(*key).distinct(), "doubled")
        rest = small_join(rest, doubled, key, "left_anti").unionByName(small_join(rest, doubled, key, "left_semi").dropDuplicates(key))
    return rest.select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage to speak of."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"), into="__hits").where("not __hits.contaminated").drop("__hits")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with their token ids."""
    return pack(docs, tokenizer_path(), SEQUENCE, END_ID)


STAGES = [
    ("quality", quality_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
