"""The queries of this package, by name, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, fingerprint, langid, linededup, lm, minhash, packing, pii, quality, toxicity
from .common import documents, table


def op1_language_id(spark, sf_dir):
    return langid.language_id(documents(spark, sf_dir))


def op2_line_dedup(spark, sf_dir):
    return linededup.line_dedup(documents(spark, sf_dir))


def op3_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir))


def op4_personal_data(spark, sf_dir):
    return pii.digest(pii.personal_data(documents(spark, sf_dir)))


def op10_toxicity(spark, sf_dir):
    return toxicity.toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op5_minhash(spark, sf_dir):
    return minhash.near_duplicates(documents(spark, sf_dir), width=2, percent=80)


def op6_quality(spark, sf_dir):
    return quality.quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op7_language_model(spark, sf_dir):
    return lm.language_model(documents(spark, sf_dir))


def op8_decontamination(spark, sf_dir):
    return decontaminate.leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op9_fingerprint(spark, sf_dir):
    return fingerprint.with_neighbours(documents(spark, sf_dir))


def queries():
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql():
    return {"op2_line_dedup": linededup.ORACLE}
