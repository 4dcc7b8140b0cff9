"""Mutation tables: counts, gene sets by sample, scores and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Variant classes that count as mutations, and those that count as high impact.
ALLOWED = [
    "frame_shift_del", "frame_shift_ins", "in_frame_del", "in_frame_ins", "missense_mutation", "nonsense_mutation", "nonstop_mutation", "splice_site", "splice_site_del", "splice_site_ins", "splice_site_snp",
    "stopcodon_dnp", "translation_start_site", "de_novo_start_outofframe",
]


def sample_name(barcode: Column, length: int | None = 12) -> Column:
    """The sample part of a barcode; the whole of it without a length."""
    return barcode if length is None else F.substring(barcode, 1, length)


def residue(change: Column) -> Column:
    """First number of an amino-acid change that starts with ``p.``; null otherwise."""
    return F.when(change.startswith("p."), F.regexp_extract(change, r"(\d+)", 1).try_cast("int"))


def is_allowed(variant: Column, allowed: list[str] | None = None) -> Column:
    return F.lower(variant).isin([v.lower() for v in (allowed or ALLOWED)])


def counts_by_sample(maf: DataFrame) -> DataFrame:
    return maf.groupBy("sample").agg(F.count(F.lit(1)).alias("mutations"))


def genes_by_sample(maf: DataFrame, allowed: list[str], lengths: DataFrame | None = None) -> DataFrame:
    """``(sample, genes)`` with sorted genes: allowed variants, known genes, positions inside the gene where lengths are given."""
    own = maf.where(is_allowed(F.col("variant"), allowed)).where(F.lower(F.col("gene").cast("string")) != "unknown")
    if lengths is not None:
        own = own.join(lengths, "gene", "left").where("length is null or position is null or position <= length")
    return own.groupBy("sample").agg(F.array_sort(F.collect_set("gene")).alias("genes"))


def homozygous(maf: DataFrame) -> DataFrame:
    return maf.where("ref <> allele1 and ref <> allele2")


def score_by_sample_gene(maf: DataFrame, high_impact: list[str]) -> DataFrame:
    """Largest score of each sample and gene; a high-impact variant has the largest score seen among the others."""
    s = F.col("score").try_cast("double") if dict(maf.dtypes)["score"] == "string" else F.col("score")
    high = is_allowed(F.col("variant"), high_impact)
    rows = maf.select("sample", "gene", high.alias("high"), s.alias("score"))
    top = rows.where("not high").agg(F.max("score").alias("top"))
    value = F.when(F.col("high"), F.col("top")).otherwise(F.col("score"))
    return rows.crossJoin(F.broadcast(top)).groupBy("sample", "gene").agg(F.max(value).alias("score")).where("score is not null")


def score_by_gene(scores: DataFrame, excluded: DataFrame) -> DataFrame:
    """Largest score of a gene over the samples that are not excluded."""
    return scores.join(excluded.select("sample"), "sample", "left_anti").groupBy("gene").agg(F.max("score").alias("score"))


def site_frequency(maf: DataFrame, lengths: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """``(gene, position, n)``: mutations by position; 0 counts as 1, positions past the gene's length are left out."""
    own = maf if excluded is None else maf.join(excluded.select("sample"), "sample", "left_anti")
    own = own.withColumn("position", F.greatest("position", F.lit(1))).join(lengths, "gene").where("position <= length")
    return own.groupBy("gene", "position").agg(F.count(F.lit(1)).alias("n"))


def site_vector(sites: DataFrame, lengths: DataFrame) -> DataFrame:
    """``(gene, counts)``: an array with one count a position."""
    at = sites.groupBy("gene").agg(F.map_from_entries(F.collect_list(F.struct("position", "n"))).alias("at"))
    full = lengths.join(at, "gene")
    return full.select("gene", F.transform(F.sequence(F.lit(1), F.col("length")), lambda i: F.coalesce(F.try_element_at("at", i), F.lit(0))).alias("counts"))


def score_key(chromosome: Column, start: Column, ref: Column, allele1: Column, allele2: Column) -> Column:
    """Key of a single-nucleotide change, heterozygous or homozygous; null for anything else."""
    single = (F.length(ref) == 1) & (F.length(allele2) == 1)
    changed = ((ref == allele1) & (allele1 != allele2)) | ((allele1 == allele2) & (ref != allele1))
    return F.when(single & changed, F.concat_ws(",", F.lit("hg19"), chromosome, start.cast("string"), ref, allele2))


def annotate_scores(maf: DataFrame, scores: DataFrame) -> DataFrame:
    """``maf`` with the score of its key; rows without one keep a null."""
    keyed = maf.withColumn("key", score_key(F.col("chromosome"), F.col("start"), F.col("ref"), F.col("allele1"), F.col("allele2")))
    return keyed.join(scores.select("key", F.col("score").alias("fi_score")), "key", "left")
