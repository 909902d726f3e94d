"""The corpus pipeline: quality rules, exact dedup, near-dedup, mixing, encoding.

run(spark, sf_dir) applies STAGES to documents, each on all that the one before kept;
each stage's rows are written as Parquet to the shared checkpoint folder and read again. All but the
last return the columns of documents. Null ids, sources and texts, repeated rows and extra columns pass the stages as each operator's
docstring says (an empty text fails the quality rules); very long texts are taken whole; an empty table gives an empty one. The tables between
the stages stay below quern-work/<application id>; quern.llm.common.clear_work removes them once the result is written. SQL can't express the last stage (nor fingerprints), so ORACLE_SQL
is None and tests hold the rows against a brute-force version.
"""

from __future__ import annotations

from quern.llm import exact_dedup, mixing, quality_rules, sentencepiece_codec, simhash
from quern.llm.common import work_place


def quality(spark, docs, sf_dir):
    """Failing lines and rejected documents go."""
    return quality_rules.clean(docs)


def exact(spark, docs, sf_dir):
    """Of equal texts the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def near(spark, docs, sf_dir):
    """Of each group of near copies (close fingerprints, or five-word shingles with a similarity of 0.8 or more) the smallest doc_id stays."""
    return simhash.drop_near_copies(docs, jaccard=True)


def mixed(spark, docs, sf_dir):
    """Sources in their target shares; a document may come twice, or in part."""
    return mixing.take(docs)


def encoded(spark, docs, sf_dir):
    """Token ids of every row: doc_id, n_chars, n_ids, ids, round_trip."""
    return sentencepiece_codec.encode(docs)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("simhash_near_dedup", near), ("mixing", mixed), ("sentencepiece", encoded)]
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        place = work_place(spark, name)
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return STAGES[-1][1](spark, docs, sf_dir)
