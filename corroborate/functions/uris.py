"""URIs and triple terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corroborate.functions.vocab import FALSE_VALUES, TRUE_VALUES

# Objects of temperature triples.
TEMPERATURES = ("Hot", "Cold", "RoomTemp")


def percent_decode(x: Column) -> Column:
    """percent-decoding that keeps '+'; text that isn't valid percent-encoding stays as it is."""
    decoded = F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)
    return F.when(F.instr(x, "%") == 0, x).otherwise(decoded)  # most have nothing to decode


def percent_encode(x: Column) -> Column:
    """percent-encoding of all but letters, digits and - _ . ~"""
    encoded = F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))
    return F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def short_uri(x: Column) -> Column:
    """decoded local name, after the last # and then the last /."""
    return F.substring_index(F.substring_index(percent_decode(x), "#", -1), "/", -1)


def entity_type(x: Column) -> Column:
    """local name up to the first |, or else up to the first _."""
    tail = short_uri(x)
    return F.when(tail.contains("|"), F.substring_index(tail, "|", 1)).otherwise(F.substring_index(tail, "_", 1))


def relation_name(x: Column) -> Column:
    """after the last /, not decoded."""
    return F.substring_index(x, "/", -1)


def is_boolean(o: Column) -> Column:
    return F.lower(F.trim(o)).isin(*TRUE_VALUES, *FALSE_VALUES)


def flip_boolean(o: Column) -> Column:
    """False for a true value, else True."""
    return F.when(F.lower(F.trim(o)).isin(*TRUE_VALUES), F.lit("False")).otherwise(F.lit("True"))


def is_temperature(o: Column) -> Column:
    return short_uri(o).isin(*TEMPERATURES)


def is_degenerate(p: Column, o: Column) -> Column:
    """A mass of zero."""
    return (F.lower(short_uri(p)) == "mass") & short_uri(o).isin("0.0", "0", "0.00")


def is_iri(x: Column) -> Column:
    return x.startswith("http://") | x.startswith("https://")


def mint(base: str, kind: str, name: Column) -> Column:
    """URI of an entity, relation, attribute, context or value."""
    return F.concat(F.lit(f"{base.rstrip('/#')}/{kind}/"), percent_encode(name))


def namespace_context(uri: Column, namespace: str) -> Column:
    """the segment after a namespace, given as a full URI or as a name; null without one."""
    decoded = percent_decode(uri)
    quoted = "".join(c if c.isalnum() or c == "_" else f"\\{c}" for c in namespace)
    full = namespace.startswith(("http://", "https://", "file://"))
    return F.nullif(F.regexp_extract(decoded, f"{quoted}([^/#]+)" if full else f"{quoted}[/#]([^/#]+)", 1), F.lit(""))


def normalised_triples(triples: Column) -> Column:
    """[s, p, o] lists with decoded subject and object and the relation's name; others are dropped."""
    return F.transform(
        F.filter(F.coalesce(triples, F.array().cast("array<array<string>>")), lambda t: F.size(t) == 3),
        lambda t: F.array(percent_decode(t[0]), relation_name(t[1]), percent_decode(t[2])),
    )
