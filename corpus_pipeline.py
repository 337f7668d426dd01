"""A training corpus from raw documents: five stages, each one operator of loomframe.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages of `run` the rows are written
as Parquet into the folder that the cluster names in spark.checkpoint.dir and read again.
"""

from __future__ import annotations

from loomframe.llm import decontam, mixing, quality, setsketch, surrogate
from loomframe.llm.common import read, written


def classify(spark, docs, sf_dir):
    """Documents that the quality rules accept."""
    return quality.accepted(docs, read(spark, sf_dir, "labels"))


def deduplicate(spark, docs, sf_dir):
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more)."""
    return setsketch.deduplicated(docs)


def decontaminate(spark, docs, sf_dir):
    """Documents without any window of a benchmark item."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def anonymise(spark, docs, sf_dir):
    """All documents, personal data and secrets replaced by surrogates."""
    return surrogate.anonymised(docs)


def mix(spark, docs, sf_dir):
    """The mix to target weights: a row for every copy that it takes, numbered from 1 in the column copy."""
    return mixing.mixed(docs)


STAGES = [("quality", classify), ("near-dedup", deduplicate), ("decontamination", decontaminate), ("pii", anonymise), ("mixing", mix)]
#: The learned classifier cannot be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
