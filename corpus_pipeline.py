"""From raw documents to packed sequences: quality rules, exact and near copies, mixing, packing.

Each stage takes what its predecessor kept, as Parquet read again, and the folder of the tables;
all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from streamquarry.llm import exact_dedup, jaccard_join, mixing, packing, quality_rules
from streamquarry.llm.rows import stored

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("exact_dedup", exact_dedup.stage),
    ("ngram_jaccard_join", jaccard_join.stage),
    ("mixing", mixing.stage),
    ("best_fit_packing", packing.stage),
]

# The verdict of the first stage comes from an iterative fit, and later stages from trees, trained
# weights and token ids: no SQL; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
