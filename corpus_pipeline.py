"""Documents made ready for training: filtered, deduplicated, mixed and packed.

``STAGES`` are applied in order; each function takes ``(spark, docs, sf_dir)`` and returns a
DataFrame, and each works on all that its predecessor kept. All but the last return the columns of
``docs``. ``ORACLE_SQL`` is None: packing needs a tokenizer, which SQL can't express, so the
pipeline is tested against a brute-force version in ``tests/llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm.common import written
from tesserae.llm.jaccard import one_of_each_group
from tesserae.llm.mixing import mixed_documents
from tesserae.llm.packing import packed_documents
from tesserae.llm.quality import quality_filter
from tesserae.llm.suffixes import without_repeats

STAGES = [
    ("quality rules", quality_filter),
    ("n-gram Jaccard join", one_of_each_group),
    ("suffix-array dedup", without_repeats),
    ("mixing sources to target weights", mixed_documents),
    ("packing", packed_documents),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences of all documents; each stage's result is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k}")
    return docs
