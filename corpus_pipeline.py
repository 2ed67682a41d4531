"""A corpus pipeline of five of the training-data operators; each stage works on all its predecessor kept.

Nulls in any column, empty and very long texts, ties and repeated rows are treated as by the
operator of a stage; an empty table stays empty; all but the last stage return the columns of
their input, whatever their names.
"""

from __future__ import annotations

import hashlib
import inspect
import os
import sys

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import bpe, common, mixing, near_dup, pretokens, quality, toxicity
from loomline.llm.common import discard, finished, materialise, passing, read, shared_dir


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; the classifier learns from the labelled rows of ``docs``.

    Null texts count as empty and stay; without labels of both kinds all rows stay or, if all are
    toxic, none does.
    """
    return toxicity.reject(docs, docs, read(spark, sf_dir, "labels"))


def quality_in(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules: the base rule (50 words, few repeats) and the adaptive thresholds.

    Null, empty and shorter texts go; null languages and sources are groups.
    """
    return quality.keep(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one of its least doc_id; null ids come last and lose no text."""
    return near_dup.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, up to twice, by their sources' targets; rows without words go, null sources are one source."""
    return mixing.repeat(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every mixed row; null texts count as empty."""
    return bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxic_out), ("quality", quality_in), ("near_dup", one_of_each), ("mixing", mixed), ("bpe", encoded)]

#: The classifier, the signatures and the encoder have no SQL form.
ORACLE_SQL = None


def stamp(spark: SparkSession, sf_dir: str) -> str:
    """What a stage's result depends on, as 16 hex digits: the input files' paths, sizes and times, and the code of stages and operators."""
    parts = []
    for name in ("documents", "labels"):
        files = read(spark, sf_dir, name).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        parts.append(os.path.join(sf_dir, name) + str(files.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("file_path", "file_size", "file_modification_time"))).first()))
    parts += [inspect.getsource(m) for m in (sys.modules[__name__], bpe, common, mixing, near_dup, pretokens, quality, toxicity)]
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:16]


def run(spark: SparkSession, sf_dir: str, name: str | None = None) -> DataFrame:
    """The last stage's rows.

    With a ``name`` of the run its stages are kept in the shared folder, under the name and the :func:`stamp`
    of its input and code; a run that is started again with both unchanged goes on after the last stage that
    was finished. Without one a stage's result goes when the next one is written; what the last one reads stays
    until Python ends.
    """
    if name is not None:
        kept = os.path.join(shared_dir(spark), name, stamp(spark, sf_dir))
        docs = read(spark, sf_dir, "documents")
        for k, (stage, f) in enumerate(STAGES):
            path = os.path.join(kept, f"{k}-{stage}")
            if not finished(spark, path):
                with passing():
                    f(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
            docs = spark.read.parquet(path)
        return docs
    docs, written = read(spark, sf_dir, "documents"), []
    with passing() as keep_last:
        for stage, f in STAGES[:-1]:
            with passing() as keep:
                docs = materialise(f(spark, docs, sf_dir), f"stage-{stage}")
                keep(docs)
            discard(*written)
            written = [docs]
        keep_last(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
