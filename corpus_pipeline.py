"""From raw documents to packed training sequences, in five stages, each written as Parquet and read again by the next.

Quality rejects documents, line dedup takes boilerplate out of the rest, near-duplicates are reduced to one document of
each group, documents that hold benchmark passages go, and what is left is packed into windows.
"""

from sextant.llm import decontaminate, linededup, minhash, packing, quality
from sextant.llm.common import documents, hold_only, table


def reject_poor(spark, docs, sf_dir):
    """The documents whose quality score reaches the threshold."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_boilerplate(spark, docs, sf_dir):
    """All documents, without the lines that are boilerplate of their source."""
    return linededup.cleaned(docs)


def drop_copies(spark, docs, sf_dir):
    """One document of each group of near-duplicates (five words, 0.8)."""
    return minhash.deduplicated(docs)


def drop_leaks(spark, docs, sf_dir):
    """The documents that hold no passage of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark, docs, sf_dir):
    """The pieces of all packed sequences."""
    return packing.pack(docs)


STAGES = [("quality", reject_poor), ("line_dedup", drop_boilerplate), ("near_dedup", drop_copies), ("decontamination", drop_leaks), ("packing", pack)]

#: The classifier, MinHash, the SVD and the tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs, before = documents(spark, sf_dir), []
    for name, stage in STAGES:
        docs = hold_only(lambda: stage(spark, docs, sf_dir), name, *before)
        before = [docs]
    return docs
