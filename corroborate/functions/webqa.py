"""Fields of web question-answer records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corroborate.functions.vocab import STRENGTH_FLOOR, TRUST_CAP, lookup

# Names in the input and what they stand for.
LABELS = {
    "supported": "supported", "refuted": "refuted",
    "not enough evidence": "not_enough_evidence", "not_enough_evidence": "not_enough_evidence",
    "conflicting evidence/cherrypicking": "conflicting_evidence", "conflicting evidence": "conflicting_evidence", "cherrypicking": "conflicting_evidence",
}
STRATEGY_OF = {
    "numerical comparison": "spatial_comparison", "written evidence": "testimonial_lookup", "consultation": "multi_hop_inference",
    "expert consultation": "multi_hop_inference", "fact-checker reference": "multi_hop_inference", "satirical source identification": "testimonial_lookup",
}
STRATEGY_TYPES = (("numerical comparison", "comparison_analogy"), ("consultation", "inference"))
MEDIA = (
    ("web_table", "web_table"), ("web_text", "web_text"), ("pdf", "pdf"), ("video", "video"), ("youtube", "video"),
    ("image", "image"), ("jpeg", "image"), ("png", "image"), ("audio", "audio"),
)
STRENGTHS = {"boolean": 0.8, "extractive": 0.8, "abstractive": 0.6, "unanswerable": 0.0}
PERCEPTUAL = ("image", "video", "audio")
NUMERIC_CUE = r"(?i)\b(%|percent|percentage|largest|smallest|rank|gdp|million|billion|trillion)\b"


def label(raw: Column) -> Column:
    """one of the four verdicts; unknown or missing is not_enough_evidence."""
    return lookup(LABELS, F.lower(F.trim(raw)), "not_enough_evidence")


def strategy(names: Column) -> Column:
    """the most telling strategy of a list."""
    mapped = F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda s: lookup(STRATEGY_OF, F.lower(F.trim(s)), "testimonial_lookup"))
    return (
        F.when(F.array_contains(mapped, "multi_hop_inference"), F.lit("multi_hop_inference"))
        .when(F.array_contains(mapped, "spatial_comparison"), F.lit("spatial_comparison"))
        .otherwise(F.lit("testimonial_lookup"))
    )


def answer_type(raw: Column) -> Column:
    name = F.lower(F.trim(raw))
    return F.when(name.isin(*STRENGTHS), name).otherwise(F.lit("unanswerable"))


def modality(medium: Column, url: Column, answer: Column) -> Column:
    """first match of the medium's name."""
    name = F.replace(F.lower(F.trim(medium)), F.lit(" "), F.lit("_"))
    out = (
        F.when(F.coalesce(medium, F.lit("")) == "", F.when(answer == "unanswerable", F.lit("unanswerable")).otherwise(F.lit("other")))
        .when(name == "metadata", F.lit("annotator_knowledge"))
        .when(name == "other", F.when(F.coalesce(url, F.lit("")) != "", F.lit("web_text")).otherwise(F.lit("other")))
    )
    for part, kind in MEDIA:
        out = out.when(name.contains(part), F.lit(kind))
    return out.otherwise(F.lit("other"))


def stance(verdict: Column) -> Column:
    """the stance that an item of a claim with this verdict takes."""
    return F.when(verdict == "supported", F.lit("supports")).when(verdict == "refuted", F.lit("refutes")).otherwise(F.lit("not_enough_evidence"))


def base_types(kind: Column, answer: Column, text: Column) -> Column:
    """evidence types by modality, answer type and numeric cues."""
    of = lambda *names: F.array(*map(F.lit, names))
    return (
        F.when(kind.isin(*PERCEPTUAL), of("perception"))
        .when(answer == "unanswerable", F.array().cast("array<string>"))
        .when(kind == "web_table", of("comparison_analogy", "testimony"))
        .when(text.rlike(NUMERIC_CUE), of("testimony", "comparison_analogy"))
        .otherwise(of("testimony"))
    )


def enriched_types(types: Column, kind: Column, answer: Column, several_urls: Column, strategies: Column) -> Column:
    """inference for abstractive answers of claims with several sources, then what strategies add."""
    names = F.transform(F.coalesce(strategies, F.array().cast("array<string>")), lambda s: F.lower(F.trim(s)))
    out = F.when(several_urls & (answer == "abstractive"), F.array_union(types, F.array(F.lit("inference")))).otherwise(types)
    # strategies add in the order in which the record lists them
    added = F.filter(
        F.transform(names, lambda s: F.when(s == STRATEGY_TYPES[0][0], F.lit(STRATEGY_TYPES[0][1])).when(s == STRATEGY_TYPES[1][0], F.lit(STRATEGY_TYPES[1][1]))),
        lambda t: t.isNotNull(),
    )
    return F.when(~kind.isin(*PERCEPTUAL) & (F.size(out) > 0), F.array_union(out, added)).otherwise(out)


def strength(answer: Column, trust: Column) -> Column:
    """F16: by answer type, capped by the trust of a source under TRUST_CAP, then at least the floor."""
    raw = lookup(STRENGTHS, answer, 0.6)
    return F.when(trust >= TRUST_CAP, raw).otherwise(F.greatest(F.lit(STRENGTH_FLOOR), F.least(raw, trust)))


def evidence_text(question: Column, answer: Column, explanation: Column) -> Column:
    """question and answer as one text, with the explanation where there is one."""
    q, a, e = (F.trim(F.coalesce(c, F.lit(""))) for c in (question, answer, explanation))
    both = F.concat(F.lit("Question: "), q, F.lit(" Answer: "), a)
    return F.when(q == "", a).when(e != "", F.concat(both, F.lit(". Explanation: "), e)).otherwise(both)


def answer_only(text: Column, least: int = 15) -> Column:
    """what follows the first `answer:`, if that has at least 15 characters, else the text."""
    found = F.trim(F.regexp_extract(text, r"(?is)answer\s*:\s*(.*)$", 1))
    return F.when(F.length(found) >= least, found).otherwise(text)
