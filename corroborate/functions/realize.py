"""Sentences from triples (F26-F34) and small text helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forms of predicates and the sentences they make, plain and negated.
TEMPLATES = {
    "prep": ("{a} is {p} {o}.", "{s} is not {p} {o}."),
    "adj": ("The {s} is {p}.", "The {s} is not {p}."),
    "attr": ("The {s}'s {p} is {o}.", "The {s}'s {p} is not {o}."),
    "verb": ("The {s} {p} the {o}.", "The {s} does not {p} the {o}."),
    "prop_state": ("The {s} is {p}.", "The {s} is not {p}."),
    "prop_value": ("The {s} is {o}.", "The {s} is not {o}."),
    "prop_verb": ("The {s} {p} {o}.", "The {s} does not {p} {o}."),
}
ABSENCE = "There is no {o} in this scene."
TEMPERATURE_TEXT = {"RoomTemp": "at room temperature", "Hot": "hot", "Cold": "cold"}


def template_fields(template: str) -> set[str]:
    """names of the fields in braces."""
    return set(re.findall(r"\{(\w+)\}", template))


def filled(template: str, required: set[str] | None = None, **fields: Column) -> Column:
    """a template with its fields filled in; ValueError if it lacks a required field, or a field has no value."""
    found = template_fields(template)
    if lacking := (required or set()) - found:
        raise ValueError(f"template without {sorted(lacking)}: {template}")
    if lacking := found - set(fields):
        raise ValueError(f"no value for {sorted(lacking)}: {template}")
    return _fill(template, **fields)


def _fill(template: str, **fields: Column) -> Column:
    out, rest = [], template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        out += [F.lit(head), fields[name]]
    return F.concat(*out, F.lit(rest))


def type_label(name: Column, acronyms: tuple[str, ...] = ("TV", "CD")) -> Column:
    """CamelCase to words, lower case but for acronyms."""
    words = F.split(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), " ")
    return F.array_join(F.transform(words, lambda w: F.when(F.upper(w).isin(*acronyms), F.upper(w)).otherwise(F.lower(w))), " ")


def sentence(text: Column) -> Column:
    """one space between words, a capital first, a full stop unless it ends a sentence."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    capital = F.concat(F.upper(F.substring(flat, 1, 1)), F.substring(flat, 2, 1 << 30))
    return F.when(flat == "", flat).when(flat.rlike(r"[.!?]$"), capital).otherwise(F.concat(capital, F.lit(".")))


def spaced(text: Column) -> Column:
    """Sentence without double articles and with a capital first."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    flat = F.replace(F.replace(flat, F.lit("the the "), F.lit("the ")), F.lit("The the "), F.lit("The "))
    return F.concat(F.upper(F.substring(flat, 1, 1)), F.substring(flat, 2, 1 << 30))


def with_article(noun: Column) -> Column:
    """a or an by the first letter (a rule, not a dictionary of pronunciations)."""
    return F.concat(F.when(noun.rlike("(?i)^[aeiou]"), F.lit("an ")).otherwise(F.lit("a ")), noun)


def list_text(text: Column) -> Column:
    """"a, b, c" -> "a, b and c"."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    n = F.size(parts)
    head = F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n == 0, F.lit("")).when(n == 1, parts[0]).otherwise(F.concat(head, F.lit(" and "), F.element_at(parts, -1)))


def object_text(predicate: Column, obj: Column) -> Column:
    """F32: how an object reads after its predicate."""
    o = F.trim(obj)
    heat = o
    for raw, text in TEMPERATURE_TEXT.items():
        heat = F.when(o == raw, F.lit(text)).otherwise(heat)
    return (
        F.when(o == "", o)
        .when(predicate == "material", F.lower(F.concat(F.lit("made up of "), list_text(o))))
        .when(predicate == "temperature", F.when(o.isin(*TEMPERATURE_TEXT), heat).otherwise(F.lower(o)))
        .when(predicate == "weighs", F.lower(F.concat(o, F.lit(" kg"))))
        .when(F.substring(o, 1, 1).rlike("^\\p{Lu}"), o)
        .otherwise(F.concat(F.lit("the "), o))
    )


def triple_text(s: Column, p: Column, o: Column, form: Column, negate: Column | bool = False) -> Column:
    """a triple as a sentence; an object that is false negates it. An unknown form gives null."""
    negative = o.isin("false", "False") | (F.lit(negate) if isinstance(negate, bool) else negate)
    fields = {"s": s, "a": with_article(s), "p": p, "o": object_text(p, o)}
    out = F.lit(None).cast("string")
    for kind, (plain, negated) in TEMPLATES.items():
        out = F.when(form == kind, F.when(negative, _fill(negated, **fields)).otherwise(_fill(plain, **fields))).otherwise(out)
    return spaced(out)


def joined_text(first: Column, second: Column, same_subject: Column, subject: Column) -> Column:
    """two sentences as one; a repeated subject is left out; a comma if the first has an `and`."""
    one = F.regexp_replace(first, r"\.+$", "")
    two = F.lower(F.regexp_replace(second, r"\.+$", ""))
    stem = F.concat(F.lit("the "), F.lower(subject), F.lit(" "))
    for verb in ("is ", "are ", "was "):
        whole = F.concat(stem, F.lit(verb))
        two = F.when(same_subject & two.startswith(whole), F.ltrim(F.substr(two, F.length(whole) + 1))).otherwise(two)
    link = F.when(F.lower(one).contains(" and "), F.lit(", and ")).otherwise(F.lit(" and "))
    return spaced(F.concat(one, link, two, F.lit(".")))


def absence_text(label: Column) -> Column:
    return spaced(_fill(ABSENCE, o=label))


def text_hash(text: Column) -> Column:
    """key of an embedding cache."""
    return F.substring(F.sha2(text, 256), 1, 16)


def title(name: Column) -> Column:
    """snake case to a title."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def shortened(text: Column, n: int) -> Column:
    """at most n characters, then an ellipsis."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def decapitalised(text: Column) -> Column:
    """the first letter in lower case, to stand after a connector."""
    return F.concat(F.lower(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))
