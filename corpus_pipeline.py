"""Corpus pipeline over documents: toxic texts, near copies and contaminated texts go, secrets are masked, the rest is packed.

Rows are documents: where ids repeat or lack, each row is judged by its own text and goes or stays by itself.
Null and empty texts stay; extra columns are carried along whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.llm import decontaminate, packing, partenum, secrets, toxicity
from plenum.llm.common import columns, cut, table

#: Near copies share 80 % of their five-word shingles.
WORDS, PERCENT = 5, 80


def by_row(docs):
    """docs and the column that tells its rows apart: doc_id, or a number of each row where ids repeat or lack."""
    if docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        return docs, "doc_id"
    name = "_row"
    while name in docs.columns:
        name = "_" + name
    return cut(docs.withColumn(name, F.monotonically_increasing_id())), name


def drop_toxic(spark, docs, sf_dir):
    """Rows that the classifier rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark, docs, sf_dir):
    """Of each component of similar texts, one row of the least doc_id stays; a row without an id only where no other has one."""
    rows, row = by_row(docs)
    found = partenum.jaccard_components(rows.select(row, "text"), row, size=WORDS, percent=PERCENT)
    if row == "doc_id":
        gone = found.filter("component_id != doc_id").select(row)
    else:
        found = cut(found.join(rows.select(row, "doc_id"), row))
        least = F.min(F.struct(F.col("doc_id").isNull().alias("lacks"), "doc_id", row))[row]
        stays = found.groupBy("component_id").agg(least.alias("stays"))
        gone = found.join(stays, "component_id").filter(F.col("stays") != F.col(row)).select(row)
    return rows.join(gone, row, "left_anti").select(columns(docs))


def drop_contaminated(spark, docs, sf_dir):
    """Rows whose text is contaminated by the benchmark go."""
    rows, row = by_row(docs)
    found = decontaminate.find_contamination(rows.select(row, "text"), table(spark, sf_dir, "benchmark"), row)
    return rows.join(found.filter("contaminated").select(row), row, "left_anti").select(columns(docs))


def mask_secrets(spark, docs, sf_dir):
    """Every secret found is masked in the text; all rows stay."""
    masked = secrets.redact_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def pack(spark, docs, sf_dir):
    """The pieces of packed sequences."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near copies", drop_near_copies), ("decontamination", drop_contaminated), ("secrets", mask_secrets), ("packing", pack)]
#: Training, signatures and tokenizers are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
