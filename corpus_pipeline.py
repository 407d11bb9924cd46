"""A corpus pipeline of five stages: each takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and reread as the next one's docs.  All stages but the last return the columns of ``documents``."""
import functools

from chronotext.llm import decontaminate, jaccard, packing, quality, suffix_dedup
from chronotext.llm.store import collecting, discard, stored

_left = []


def staged(function):
    """A stage that first deletes what the stage before left in the shared folder: its result has been written by then."""
    @functools.wraps(function)
    def stage(spark, docs, sf_dir):
        discard(*_left)
        _left.clear()
        with collecting(_left):
            return function(spark, docs, sf_dir)
    return stage


@staged
def quality_stage(spark, docs, sf_dir):
    """Documents that the quality classifier rejects go."""
    return quality.keep(docs)


@staged
def near_duplicate_stage(spark, docs, sf_dir):
    """One document, that of the smallest id, stays of each group of near copies (five words, similarity 0.8)."""
    return jaccard.one_of_each(docs)


@staged
def repeat_stage(spark, docs, sf_dir):
    """Strings of 200 bytes that also start elsewhere go; so do documents of which nothing is left."""
    return suffix_dedup.dedup(docs)


@staged
def decontamination_stage(spark, docs, sf_dir):
    """Passages of the benchmark go; so do documents that are mostly such passages."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@staged
def packing_stage(spark, docs, sf_dir):
    """Token pieces with their sequences and offsets."""
    return packing.pack_pieces(stored(packing.token_pieces(docs, with_ids=False), "pieces"))


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("repeats", repeat_stage),
          ("decontamination", decontamination_stage), ("packing", packing_stage)]

# Automata, suffix arrays, tokenizers and trained models are beyond SQL; the tests compare stages with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        read, docs = docs, stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if hasattr(read, "stored_at"):
            discard(read)
    discard(*_left)
    _left.clear()
    return docs
