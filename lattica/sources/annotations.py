"""Annotations by type: the files that a type of annotation is made of, read, renamed and put under one name of terms."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.sources import readers

#: Aspects of the ontology by type of annotation.
ASPECTS = {"BP": "P", "MF": "F", "CC": "C"}
#: Types that are a plain map of keys to terms.
MAPS = ("pathway", "curated_pathway", "mouse_pathway", "reaction")


def annotation_of_type(spark: SparkSession, files: Mapping[str, str], kind: str = "pathway") -> DataFrame:
    """``(key, term)`` of one type of annotation.

    ``files`` names the path of each map type; for the ontology's types it names ``ontology`` (proteins and term ids),
    ``ontology_names`` (term ids and names) and ``protein_names`` (proteins and gene names). Proteins without a gene name
    and terms without a name are left out; proteins of one gene give the union of their terms. A type whose file is not
    named is an error, as is an unknown type.
    """
    if kind in MAPS:
        return readers.key_terms(spark, files[kind])
    if kind not in ASPECTS:
        raise ValueError(f"unknown type of annotation {kind}")
    names = readers.key_terms(spark, files["protein_names"]).withColumnRenamed("term", "name")
    by_gene = readers.renamed_keys(readers.gene_ontology(spark, files["ontology"], ASPECTS[kind]), names)
    named = readers.with_names(by_gene, readers.ontology_names(spark, files["ontology_names"]))
    return named.where(F.col("name").isNotNull()).select("key", F.col("name").alias("term")).distinct()


def all_annotations(spark: SparkSession, files: Mapping[str, str]) -> DataFrame:
    """``(key, term, type)`` of every type whose files are named."""
    kinds = [k for k in MAPS if k in files]
    if {"ontology", "ontology_names", "protein_names"} <= set(files):
        kinds += list(ASPECTS)
    if not kinds:
        raise KeyError("no file of any type of annotation is named")
    parts = [annotation_of_type(spark, files, k).withColumn("type", F.lit(k)) for k in kinds]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def counts(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """``(first, n, last)`` of count files: lines of a name, a whole number and perhaps a second name, parted by tabs."""
    p = F.split("value", "\t")
    rows = readers.lines(spark, path).select(p[0].alias("first"), p[1].try_cast("long").alias("n"), F.get(p, F.lit(2)).alias("last"))
    return rows.where("n is not null") if header else rows
