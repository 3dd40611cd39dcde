"""Web domains and URLs: normalised names, subdomains, public-sector suffixes, archive links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of two labels that belong together, social-media domains, public-sector suffixes.
COMPOUND_SUFFIXES = (
    "co.uk", "gov.uk", "ac.uk", "org.uk", "me.uk", "net.uk", "co.in", "gov.in", "ac.in", "co.za", "gov.za", "ac.za",
    "gov.au", "com.au", "edu.au", "net.au", "org.au", "gov.ng", "gov.gh", "gov.ke", "gouv.fr",
)
SOCIAL_DOMAINS = ("twitter.com", "x.com", "facebook.com", "instagram.com", "reddit.com", "tiktok.com", "linkedin.com", "youtube.com", "t.co", "fb.com")
GOVERNMENT_SUFFIXES = ("gov", "gov.uk", "gov.au", "gov.in", "gov.za", "gov.ng", "gov.gh", "gov.ke", "gouv.fr", "go.ke", "go.ug", "go.tz", "nhs.uk")
EDUCATION_SUFFIXES = ("edu", "ac.uk", "ac.in", "ac.za", "edu.au")
ARCHIVE_HOST = "web.archive.org"
ARCHIVED = r"web\.archive\.org/web/[0-9]+[^/]*/(.+)"


def bare_domain(host: Column) -> Column:
    """Lower case, without a leading www."""
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def registry_name(domain: Column) -> Column:
    """the domain without its (compound) suffix, in snake case: news.bbc.co.uk -> news_bbc."""
    parts = F.split(domain, r"\.")
    n = F.size(parts)
    tail = F.array_join(F.slice(parts, -2, 2), ".")
    cut = F.when((n >= 3) & tail.isin(*COMPOUND_SUFFIXES), n - 2).when(n >= 2, n - 1).otherwise(n)
    return F.translate(F.array_join(F.slice(parts, F.lit(1), cut), "."), ".-", "__")


def parent_domain(domain: Column) -> Column:
    """without the first label, if more than two remain to choose from."""
    return F.when(F.size(F.split(domain, r"\.")) > 2, F.regexp_replace(domain, r"^[^.]*\.", "")).otherwise(domain)


def _ends_with(domain: Column, suffixes: tuple[str, ...]) -> Column:
    return domain.rlike(r"(^|\.)(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")


def suffix_source(domain: Column, modality: Column) -> Column:
    """the registry key that the suffix of a public-sector or academic domain stands for, or null."""
    pdf = modality == "pdf"
    return F.when(
        _ends_with(domain, GOVERNMENT_SUFFIXES), F.when(pdf, F.lit("government_pdf")).otherwise(F.lit("government_web_text"))
    ).when(_ends_with(domain, EDUCATION_SUFFIXES), F.when(pdf, F.lit("academic_pdf")).otherwise(F.lit("general_web_text")))


def is_social(domain: Column) -> Column:
    return domain.isin(*SOCIAL_DOMAINS) | parent_domain(domain).isin(*SOCIAL_DOMAINS)


def source_key(domain: Column, modality: Column) -> Column:
    """F8: candidate registry key of a domain and a modality."""
    return F.concat_ws("_", registry_name(bare_domain(domain)), modality)


def unwrapped_url(url: Column) -> Column:
    """the page behind an archive link (https unless it says otherwise); other URLs as they are."""
    inner = F.regexp_extract(url, ARCHIVED, 1)
    return F.when(inner == "", url).when(inner.rlike("^https?://"), inner).otherwise(F.concat(F.lit("https://"), inner))


def url_host(url: Column) -> Column:
    """host with port, in lower case, without www.; null where there is none."""
    host = bare_domain(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return F.when(host != "", host)


def url_modality(url: Column) -> Column:
    """pdf by suffix, else web_text."""
    return F.when(F.lower(url).endswith(".pdf"), F.lit("pdf")).otherwise(F.lit("web_text"))
