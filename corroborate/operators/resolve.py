"""Resolving domains to registered sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corroborate.functions import domains as D
from corroborate.functions.vocab import SOURCE_CATEGORY_OF, lookup


def resolve_sources(items: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds source_id, the first that applies of: exact key, parent domain's key, web archive,
    suffix key, social media, default of the modality, unknown.

    items: domain (lower case, no www.; null: unknown_web), modality. One left join for each step
    that asks whether a key is registered; the registry's keys are distinct, so no row is added.
    """
    known = registry.select(F.col("source_id").alias("_id")).distinct()
    domain, modality = F.col("domain"), F.col("modality")
    steps = {
        "_exact": D.source_key(domain, modality),
        "_parent": F.when(D.parent_domain(domain) != domain, D.source_key(D.parent_domain(domain), modality)),
        "_suffix": D.suffix_source(domain, modality),
    }
    out = items
    for name, key in steps.items():
        out = out.withColumn(f"{name}_key", key)
        out = out.join(known.withColumnRenamed("_id", name), F.col(f"{name}_key") == F.col(name), "left")
    default = F.when(modality == "web_table", F.lit("general_web_table")).when(modality == "pdf", F.lit("academic_pdf")).otherwise(F.lit("unknown_web"))
    source = (
        F.when(domain.isNull() | (domain == ""), F.lit("unknown_web"))
        .when(F.col("_exact").isNotNull(), F.col("_exact"))
        .when(F.col("_parent").isNotNull(), F.col("_parent"))
        .when(domain == D.ARCHIVE_HOST, F.lit("webarchive_web_text"))
        .when(F.col("_suffix").isNotNull(), F.col("_suffix"))
        .when(D.is_social(domain), F.lit("social_media_web_text"))
        .otherwise(default)
    )
    return out.withColumn("source_id", source).drop(*steps, *(f"{n}_key" for n in steps))


def resolve_urls(items: DataFrame, registry: DataFrame) -> DataFrame:
    """Source of each URL (column url) and modality: annotator knowledge, or J3 on the host behind
    an archive link."""
    hosted = items.withColumn("domain", D.url_host(D.unwrapped_url(F.col("url"))))
    annotator = (F.col("modality") == "annotator_knowledge") | (F.lower(F.trim("url")) == "metadata")
    return resolve_sources(hosted, registry).withColumn("source_id", F.when(annotator, F.lit("annotator_knowledge")).otherwise(F.col("source_id")))


def registry_gaps(registry: DataFrame) -> DataFrame:
    """Generic keys {source_type}_{modality} that the registry's own entries need and lack."""
    needed = registry.select(F.concat_ws("_", "source_type", "modality").alias("source_id")).distinct()
    return needed.join(registry.select("source_id"), "source_id", "left_anti")


def checked_registry(registry: DataFrame) -> DataFrame:
    """The registry, or ValueError if generic entries are missing."""
    missing = [r.source_id for r in registry_gaps(registry).orderBy("source_id").limit(50).collect()]
    if missing:
        raise ValueError(f"missing generic entries: {missing}")
    return registry


def source_categories(items: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds the encoder category of each item's source; unknown where it has none."""
    kinds = registry.select("source_id", "source_type")
    return items.join(kinds, "source_id", "left").withColumn("category", lookup(SOURCE_CATEGORY_OF, F.col("source_type"), "unknown")).drop("source_type")


def missing_domains(curated: DataFrame, registry: DataFrame) -> DataFrame:
    """Curated domains (domain, modality, ...) that no registered source resolves yet."""
    resolved = resolve_sources(curated, registry)
    fallback = F.col("source_id").isin("unknown_web", "general_web_table", "academic_pdf")
    return resolved.where(fallback).drop("source_id")


def uncovered_domains(seen: DataFrame, curated: DataFrame) -> DataFrame:
    """Domains that occur and that the curated list doesn't have, with how often."""
    return seen.groupBy("domain").agg(F.count("*").alias("n")).join(curated.select("domain").distinct(), "domain", "left_anti")


def enriched_registry(registry: DataFrame, curated: DataFrame) -> DataFrame:
    """The registry with entries for the missing curated domains (domain, source_type, modality,
    source_trust); papers and governments get an entry for pdf as well."""
    new = missing_domains(curated, registry)
    pdf = new.where(F.col("source_type").isin("scientific_paper", "government") & (F.col("modality") != "pdf")).withColumn("modality", F.lit("pdf"))
    entries = new.unionByName(pdf).withColumn("source_id", D.source_key(F.col("domain"), F.col("modality")))
    entries = entries.join(registry.select("source_id"), "source_id", "left_anti").dropDuplicates(["source_id"])
    return registry.unionByName(entries.select(*(c for c in registry.columns if c in entries.columns)), allowMissingColumns=True)


def trust_averages(registry: DataFrame) -> DataFrame:
    """Mean and median trust of a registry."""
    return registry.agg(F.round(F.avg("source_trust"), 4).alias("mean_trust"), F.round(F.median("source_trust"), 4).alias("median_trust"), F.count("*").alias("n"))


def trust_ranges(registry: DataFrame) -> DataFrame:
    """Least and most trust of each source type."""
    return registry.groupBy("source_type").agg(F.min("source_trust").alias("min_trust"), F.max("source_trust").alias("max_trust"))
