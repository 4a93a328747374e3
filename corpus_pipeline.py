"""From raw documents to token ids: toxicity, line dedup, near duplicates, mixture, byte-level BPE.

Each stage works on all that the one before kept; ``run`` writes each stage's result to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framelake.llm.bpe import encoded
from framelake.llm.common import table, written
from framelake.llm.jaccard import near_duplicate_stage
from framelake.llm.lines import line_dedup_stage
from framelake.llm.mixture import mixture_stage
from framelake.llm.toxicity import toxicity_stage


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and checksums of each document of the mix; nulls and empty texts have no ids, repeated rows
    have the same, no rows give none, and other columns are left out."""
    import public_tokenizers as P

    return encoded(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=True).drop("decoded")


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixture", mixture_stage),
    ("token_ids", token_ids),
]

#: A trained network and learned merges have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs


QUERIES = {"pipeline": run}
ORACLE_QUERIES: dict[str, str] = {}
