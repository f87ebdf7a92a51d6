"""The corpus pipeline: raw documents to packed training sequences, one operator of ``pagesift.llm`` a stage.

Every stage takes (spark, docs, sf_dir) and reads ``docs`` as the stage before wrote it; all but the last return
documents with their columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.llm import decontamination, packing, simhash, substring_dedup, toxicity
from pagesift.llm.common import key_of, keyed, stage
from pagesift.llm.queries import tokenizer_path
from pagesift.sources.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity (4): documents with a score of 0.5 or more go, judged row by row in one pass without a shuffle.  Null and
    empty texts are scored like any other, repeated rows alike; an empty table stays empty; all columns are kept as they are."""
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup (7): of each component of fingerprints one row stays, that with the smallest id (null last),
    then the smallest text digest, then the smallest other columns in their order.  A row is known by its id and digest, so null or repeated ids in different
    components all stay; of exact copies of a row one stays.  Null and empty texts have fingerprint zero and are one component; an empty table stays empty; no column name clashes."""
    rows = keyed(docs).join(simhash.first_rows(docs), ["k", "d"], "left_semi")
    return rows.groupBy("k", "d").agg(F.min("doc").alias("doc")).select("doc.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup (5): words in repeated windows go; n_chars follows the text; a document that loses all its
    words goes; texts without repeats stay as they are, null and empty ones too.  Rows of equal id and text share their result; an empty table stays
    empty; no column name clashes."""
    cut = substring_dedup.remove_repeats(docs).where("n_removed > 0").select(
        key_of("doc_id").alias("k"), F.col("text_hash").alias("h"), F.col("kept"), (F.col("n_removed") == F.col("n_words")).alias("gone")).distinct()
    rows = keyed(docs).withColumn("h", F.xxhash64(F.coalesce("doc.text", F.lit(""))))
    out = rows.join(cut, ["k", "h"], "left").where(~F.coalesce("gone", F.lit(False)))

    def column(field):
        c = F.col("doc")[field.name]
        if field.name == "text":
            return F.coalesce("kept", c)
        return F.when(F.col("kept").isNull(), c).otherwise(F.length("kept").cast(field.dataType)) if field.name == "n_chars" else c

    return out.select(*[column(f).alias(f.name) for f in docs.schema])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (9): documents that hold a window of a benchmark item go; see ``decontaminate`` for
    nulls, empties, repeats and clashing names."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing (6): one row per piece with its sequence and place.  Null and empty texts are one piece of the end id; see ``pack``."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("substring_dedup", cut_repeats),
          ("decontamination", drop_contaminated), ("packing", pack_sequences)]

#: Trained scores, XXH64 fingerprints and token ids have no SQL; tests/llm holds the stages to brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES:
        out = f(spark, docs, sf_dir)
        docs = stage(out, f"pipeline-{name}")
    return docs
