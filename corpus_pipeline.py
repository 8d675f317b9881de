"""The corpus pipeline: five stages, each one operator of `renewscope.llm` over all rows it gets."""

from __future__ import annotations

from pyspark.sql import functions as F

from renewscope.llm.common import table
from renewscope.llm.mixing import mixed_documents
from renewscope.llm.packing import pack_documents
from renewscope.llm.secrets import masked_documents
from renewscope.llm.simhash import deduplicated
from renewscope.llm.simhash_query import DISTANCE, SHINGLE
from renewscope.llm.tokens import default_tokenizer
from renewscope.llm.toxicity import toxicity, train
from renewscope.llm.toxicity_query import THRESHOLD, known_labels
from renewscope.session import through_table


def drop_toxic(spark, docs, sf_dir):
    """Documents whose score reaches the threshold go; all others stay as they are."""
    model = train(docs, known_labels(spark, sf_dir))
    return docs.where(toxicity(spark, model, F.col("text")) < THRESHOLD)


def deduplicate(spark, docs, sf_dir):
    """Of each SimHash group the document of the smallest id stays."""
    return deduplicated(docs, shingle=SHINGLE, distance=DISTANCE)


def mask_secrets(spark, docs, sf_dir):
    """Secrets are masked; every document stays."""
    return masked_documents(docs)


def mix_sources(spark, docs, sf_dir):
    """Each document as often as the mix takes it."""
    return mixed_documents(docs)


def pack(spark, docs, sf_dir):
    """Windows of token ids, one row a piece."""
    return pack_documents(docs, default_tokenizer())


STAGES = [
    ("drop_toxic", drop_toxic),
    ("deduplicate", deduplicate),
    ("mask_secrets", mask_secrets),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: No SQL: learned scores, XXH64 and a tokenizer are not SQL; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over `documents`, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = through_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
