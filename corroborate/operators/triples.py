"""Queries and groupings over triples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.functions import uris as U
from corroborate.functions.vocab import FALSE_VALUES, TRUE_VALUES
from corroborate.operators.lineage import ROWS_PER_TASK, tasks_for

SPO = ["s", "p", "o"]


def dedupe(triples: DataFrame, order: str | None = None) -> DataFrame:
    """Each triple once; with an order column, the first of its copies."""
    if order is None:
        return triples.dropDuplicates(SPO)
    first = F.min_by(F.struct(*triples.columns), order).alias("x")  # copies meet in the partial aggregate
    return triples.groupBy(*(F.col(c).alias(f"_{c}") for c in SPO)).agg(first).select("x.*")


def match(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Triples with the given terms; None matches all. The filters reach the scan."""
    wanted = [F.col(c) == v for c, v in zip(SPO, (s, p, o), strict=True) if v is not None]
    return triples.where(reduce(Column.__and__, wanted)) if wanted else triples


def exists(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> bool:
    """Whether a pattern has a match; stops at the first."""
    return not match(triples, s, p, o).isEmpty()


def objects_of(triples: DataFrame, s: str, predicates: list[str]) -> DataFrame:
    """P3, with repeats."""
    return triples.where((F.col("s") == s) & F.col("p").isin(*predicates)).select("o")


def subjects_of(triples: DataFrame, o: str, predicates: list[str]) -> DataFrame:
    """P4, with repeats."""
    return triples.where((F.col("o") == o) & F.col("p").isin(*predicates)).select("s")


def nodes_of(triples: DataFrame, predicates: list[str]) -> DataFrame:
    """Subjects and objects of predicates, each once."""
    found = triples.where(F.col("p").isin(*predicates))
    return found.select(F.explode(F.array("s", "o")).alias("node")).distinct()


def boolean_predicates(triples: DataFrame) -> DataFrame:
    """P5 for every (s, p): whether any of its objects is a boolean."""
    is_bool = F.lower(F.trim("o")).isin(*TRUE_VALUES, *FALSE_VALUES)
    return triples.groupBy("s", "p").agg(F.bool_or(is_bool).alias("is_boolean"))


def group_by(triples: DataFrame, field: str) -> DataFrame:
    """Triples of each subject, predicate or object, as sorted lists.

    A list is the result; where a count or a digest will do, group_sizes has no such lists.
    """
    key = {"subject": "s", "predicate": "p", "object": "o"}[field]
    return triples.groupBy(F.col(key).alias("key")).agg(F.sort_array(F.collect_list(F.struct(*SPO))).alias("triples"))


def group_sizes(keyed: DataFrame, key: str = "key") -> DataFrame:
    """Number of triples, subjects and objects of each group."""
    return keyed.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct("s").alias("n_subjects"), F.count_distinct("o").alias("n_objects"))


def _last(mapping: DataFrame, order: str) -> DataFrame:
    """(node, value): of several values the last in order."""
    return mapping.where("value is not null").groupBy("node").agg(F.max_by("value", order).alias("value"))


def _mapped(triples: DataFrame, direct: Column, mapping: DataFrame, hot: int = ROWS_PER_TASK) -> DataFrame:
    """Adds key: the direct value, or the mapping's for the subject, or for the object.

    A term of more than `hot` triples ("false" may be the object of most) would be one task's: what the
    mapping says of such terms, at most triples / hot of them, goes to every task. Triples with other
    terms are dealt by the term, and those that have their key are not looked up again.
    """
    n = tasks_for(triples)
    keyed = triples.withColumn("key", direct)
    for term in ("s", "o"):
        node = F.col(term).alias("_node")
        often = triples.groupBy(node).agg(F.count("*").alias("_n")).where(F.col("_n") > hot).select("_node")
        known = mapping.select(F.col("node").alias("_node"), F.col("value").alias("_value"))
        told = F.broadcast(often.join(known, "_node", "left").withColumn("_often", F.lit(True)))
        met = keyed.join(told, F.col(term).eqNullSafe(F.col("_node")), "left").withColumn("key", F.coalesce("key", "_value")).drop("_node", "_value")
        settled = F.col("key").isNotNull() | F.col("_often").isNotNull() | F.col(term).isNull()
        asked = met.where(~settled).drop("_often", "key").repartition(n, term).join(known.repartition(n, "_node"), F.col(term) == F.col("_node"), "left")
        keyed = met.where(settled).drop("_often").unionByName(asked.drop("_node").withColumnRenamed("_value", "key"))
    return keyed


def by_context(triples: DataFrame, namespace: str, order: str = "ord") -> DataFrame:
    """Adds key, the context of a triple: from its own terms, or from the context that
    hasObject and inScene triples give its subject or object. Triples without one are dropped."""
    pred = F.lower(U.short_uri(F.col("p")))
    of = lambda term: U.namespace_context(F.col(term), namespace)
    mapping = triples.where(pred.isin("hasobject", "inscene")).select(
        F.when(pred == "hasobject", F.col("o")).otherwise(F.col("s")).alias("node"),
        F.when(pred == "hasobject", of("s")).otherwise(of("o")).alias("value"),
        order,
    )
    return _mapped(triples, F.coalesce(of("s"), of("o")), _last(mapping, order)).where("key is not null")


def by_entity(triples: DataFrame, pattern: str, forward: str, backward: str, default: str = "UNKNOWN", order: str = "ord") -> DataFrame:
    """Adds key, the entity of a triple: the pattern's match in its terms, or what forward
    (entity in the subject) and backward (entity in the object) triples give its nodes."""
    pred = F.lower(U.short_uri(F.col("p")))
    found = lambda term: F.nullif(F.regexp_extract(U.percent_decode(F.col(term)), pattern, 0), F.lit(""))
    mapping = triples.where(pred.isin(forward.lower(), backward.lower())).select(
        F.when(pred == forward.lower(), F.col("o")).otherwise(F.col("s")).alias("node"),
        F.when(pred == forward.lower(), found("s")).otherwise(found("o")).alias("value"),
        order,
    )
    keyed = _mapped(triples, F.coalesce(found("s"), found("o")), _last(mapping, order))
    return keyed.withColumn("key", F.coalesce("key", F.lit(default)))


def by_pattern(triples: DataFrame, pattern: str, predicates: list[str] | None = None, match_on: str = "subject", key_by: str = "entity", regex: bool = False) -> DataFrame:
    """Adds key to the triples whose subject or object has the pattern (a substring, or a regex)."""
    target = F.col({"subject": "s", "object": "o"}[match_on])
    found = triples.where(target.rlike(pattern) if regex else target.contains(pattern))
    if predicates:
        found = found.where(F.col("p").isin(*predicates))
    return found.withColumn("key", {"entity": target, "predicate": F.col("p")}[key_by])


def scene_triples(objects: DataFrame, ontology: DataFrame, base: str) -> DataFrame:
    """Triples of scene objects (scene_id, object_id, object_type, properties, relations).

    properties: map of string to string; relations: array of (predicate, object). Membership once
    per object (Q16), rdf type, then the properties and relations whose predicate the ontology
    (name, uri) maps; others are dropped. A set, as in RDF.
    """
    entity = U.mint(base, "entities", F.col("object_id"))
    # all that is said of an entity is made, and made distinct, in the task that its object is dealt to
    own = objects.select("scene_id", "object_type", "properties", "relations", entity.alias("_e")).repartition(tasks_for(objects, ROWS_PER_TASK // 5), "_e")
    none = F.lit(None).cast("string")
    said = lambda name, s, p, o: F.struct(name.alias("name"), s.alias("s"), p.alias("p"), o.alias("o"))
    member = said(none, U.mint(base, "contexts", F.col("scene_id")), F.lit(f"{base}/relations/hasObject"), F.col("_e"))
    kind = said(none, F.col("_e"), F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#type"), U.mint(base, "types", F.col("object_type")))
    data = F.filter(F.transform(F.map_entries("properties"), lambda x: said(x["key"], F.col("_e"), none, x["value"])), lambda x: x["o"].isNotNull())
    links = F.transform("relations", lambda r: said(r["predicate"], F.col("_e"), none, U.mint(base, "entities", r["object"])))
    nothing = F.array().cast("array<struct<name: string, s: string, p: string, o: string>>")
    every = own.select("_e", F.explode(F.concat(F.array(member, kind), F.coalesce(data, nothing), F.coalesce(links, nothing))).alias("x")).select("_e", "x.*")
    mapped = every.join(F.broadcast(ontology.select("name", "uri")), "name", "left").withColumn("p", F.coalesce("p", "uri")).where("p is not null")
    return mapped.dropDuplicates(["_e", *SPO]).select(*SPO)


def with_labels(triples: DataFrame, predicates: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Adds p_label and form by the lexicon of predicates (predicate, label, form), and s_label.

    Triples with an unknown predicate are dropped. entities (entity, label) names subjects by their
    local name; without an entry the label is that name in lower case.
    """
    # the lexicon goes to every task: dealt by predicate, most triples would be a few tasks'
    known = F.broadcast(predicates.select(F.col("predicate").alias("_p"), F.col("label").alias("p_label"), "form"))
    named = triples.join(known, U.relation_name(F.col("p")) == F.col("_p")).drop("_p")
    local = U.short_uri(F.col("s"))
    if entities is None:
        return named.withColumn("s_label", F.lower(local))
    labels = entities.select(F.col("entity").alias("_e"), F.col("label").alias("s_label"))
    return named.join(labels, local == F.col("_e"), "left").drop("_e").withColumn("s_label", F.coalesce("s_label", F.lower(local)))
