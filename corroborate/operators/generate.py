"""Claims generated from triples and templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corroborate.functions import formula
from corroborate.functions import uris as U
from corroborate.functions.realize import decapitalised
from corroborate.functions.vocab import DEFAULT_TRUST, EVIDENCE_WEIGHTS, lookup
from corroborate.operators.lineage import checkpointed, tasks_for
from corroborate.operators.profile import distributions
from corroborate.operators.splits import _ranked, apportion, seeded_order
from corroborate.operators.triples import SPO


def _key() -> Column:
    return F.concat_ws("|", "s", "p", "o")


# Strings that leak into types of objects but name none.
NO_TYPES = ("true", "false", "yes", "no", "null", "none")
#: Types that a context meets at once, about, where it is paired with the universe.
TYPES_PER_BLOCK = 1000


def is_object_type(name: Column) -> Column:
    """Not a boolean or null that was written as a type."""
    return ~F.lower(F.trim(name)).isin(*NO_TYPES)


def _object_types(universe: DataFrame) -> DataFrame:
    return universe.select("object_type").where(F.col("object_type").isNotNull() & is_object_type(F.col("object_type"))).distinct()


def absent_types(universe: DataFrame, present: DataFrame) -> DataFrame:
    """(context, object_type) of the universe (object_type) that a context doesn't have: every pair.

    present: (context, object_type). The types are dealt to blocks by hash, and each context meets each
    block once, with what it has of the block. A row holds a block, never the universe or all that a
    context has, and no pair is shuffled: pairs are made where they are returned. The result grows with
    contexts x types; where counts, asked pairs or draws will do, the functions below don't make it.
    """
    types = _object_types(universe)
    n = max(1, -(-types.count() // TYPES_PER_BLOCK))
    block = F.pmod(F.xxhash64("object_type"), F.lit(n)).alias("block")
    blocks = types.groupBy(block).agg(F.collect_list("object_type").alias("_types"))
    has = present.select("context", "object_type")
    held = has.where(F.col("object_type").isNotNull()).groupBy("context", block).agg(F.collect_set("object_type").alias("_held"))
    each = has.select("context").distinct().select("context", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("block"))
    on = [each["context"].eqNullSafe(held["context"]), each["block"] == held["block"]]
    met = each.join(held, on, "left").select(each["context"], each["block"], "_held").join(blocks, "block")
    lacks = F.when(F.col("_held").isNull(), F.col("_types")).otherwise(F.array_except("_types", "_held"))
    return met.select("context", F.explode(lacks).alias("object_type"))


def absent_counts(universe: DataFrame, present: DataFrame) -> DataFrame:
    """(context, n_present, n_absent): how many types of the universe a context has and lacks.

    What is absent is the universe without what is present, and both of these are tables already; the
    pairs themselves grow with contexts x types and are made for what is asked (absent_among) or drawn
    (absence_draws) only. present: (context, object_type); the universe's size is one number.
    """
    types = _object_types(universe)
    known = present.select("context", "object_type").distinct().join(types.withColumn("_known", F.lit(1)), "object_type", "left")
    counts = known.groupBy("context").agg(F.count("_known").alias("n_present"))
    return counts.select("context", "n_present", (F.lit(types.count()) - F.col("n_present")).alias("n_absent"))


def absent_among(asked: DataFrame, universe: DataFrame, present: DataFrame) -> DataFrame:
    """Those of the asked pairs (context, object_type) whose type is in the universe and not
    in the context. Two joins, both in size of the asked pairs."""
    on = ["context", "object_type"]
    return asked.select(*on).distinct().join(_object_types(universe), "object_type", "left_semi").join(present.select(*on), on, "left_anti").select(*on)


def absence_draws(universe: DataFrame, present: DataFrame, per_context: int, seed: int = 42) -> DataFrame:
    """(context, object_type): per_context types that a context lacks, or all if it lacks fewer.

    The types lie on a ring in the seeded order. A context starts at a seeded place of its own and
    takes the first types that it doesn't have. Among per_context places and as many more as it has
    types there are enough, so no more of them are made than that: contexts x per_context plus the
    size of `present`, never contexts x types.
    """
    ring = _ranked(_object_types(universe), "object_type", [F.lit(0)], seed).select((F.col("_place") - 1).alias("at"), "object_type")
    has = present.select("context", "object_type").distinct()
    n = ring.count()
    start = F.conv(F.substring(seeded_order(F.concat(F.lit("ring-"), F.col("context").cast("string")), seed), 1, 8), 16, 10).cast("long")
    sizes = has.groupBy("context").agg(F.count("*").alias("n")).where(F.lit(n) > 0)
    tried = F.sequence(F.lit(0).cast("long"), F.least(F.col("n") + per_context, F.lit(n)) - 1)
    places = sizes.select("context", start.alias("start"), F.explode(tried).alias("step")).withColumn("at", (F.col("start") + F.col("step")) % F.lit(max(n, 1)))
    free = places.join(ring, "at").join(has, ["context", "object_type"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("context").orderBy("step"))
    return free.withColumn("_r", nth).where(F.col("_r") <= per_context).select("context", "object_type")


def preferred_receptacles(triples: DataFrame, rules: DataFrame, *more: str) -> DataFrame:
    """(s, p, o, receptacle): where the subject's type could be, by rules (object_type, receptacle), with
    more of their columns if asked."""
    return triples.join(rules.select(F.lower("object_type").alias("_t"), "receptacle", *more), F.lower(U.entity_type(F.col("s"))) == F.col("_t")).drop("_t")


def semantic_map(objects: DataFrame) -> DataFrame:
    """Object type -> sorted types of its parents. objects: object_id, object_type, parent_id."""
    parents = objects.select(F.col("object_id").alias("parent_id"), F.col("object_type").alias("parent_type"))
    pairs = objects.join(parents, "parent_id").select("object_type", "parent_type").distinct()
    return pairs.groupBy("object_type").agg(F.sort_array(F.collect_list("parent_type")).alias("parent_types"))


def _each_once(triples: DataFrame, n: int) -> DataFrame:
    """Distinct (s, p, o), dealt to n tasks before they are compared, so no task that reads holds them."""
    return triples.select(*SPO).repartition(n, *SPO).dropDuplicates(SPO)


def _usable(triples: DataFrame, n: int) -> DataFrame:
    return _each_once(triples.where(~U.is_degenerate(F.col("p"), F.col("o"))), n)


def corruption_candidates(triples: DataFrame, rules: DataFrame, seed: int = 42, n: int | None = None) -> DataFrame:
    """For each triple one wrong object, by the first way that gives one: flip a boolean,
    change a temperature, put it where its type could be but isn't.

    Adds bad_o and how. Candidates that are true triples are anti-joined; the receptacle's object
    comes from the distinct objects of its type, first in the seeded order. n: tasks to deal the triples to
    (without: by their number). rules, one row a type and receptacle, go to every task with that object.
    """
    n = n or tasks_for(triples)
    rows = _each_once(triples, n)
    temperature = U.short_uri(F.col("o"))
    order = list(("Hot", "Cold", "RoomTemp"))
    heat = F.lit(None).cast("string")
    for i, t in enumerate(order):
        heat = F.when(temperature == t, F.lit(order[(i + 1) % len(order)])).otherwise(heat)
    way = lambda rank, how, bad_o: F.struct(F.lit(rank).alias("rank"), F.lit(how).alias("how"), bad_o.alias("bad_o"))
    flip = F.when(U.is_boolean(F.col("o")), U.flip_boolean(F.col("o")))
    ways = F.filter(F.array(way(0, "boolean_flip", flip), way(1, "temperature_change", heat)), lambda x: x["bad_o"].isNotNull())
    changed = triples.select(*SPO, F.explode(ways).alias("x")).select(*SPO, "x.*")
    # one object for each type of receptacle in the seeded order, so that a type doesn't multiply rows; only types that rules name
    receptacles = F.broadcast(rules.select("receptacle").distinct())
    places = triples.select(F.col("o").alias("bad_o"), U.entity_type(F.col("o")).alias("receptacle")).join(receptacles, "receptacle", "left_semi")
    one = places.groupBy("receptacle").agg(F.min(F.struct(seeded_order(F.col("bad_o"), seed).alias("k"), "bad_o")).alias("x")).select("receptacle", "x.bad_o")
    to = F.broadcast(rules.join(F.broadcast(one), "receptacle"))
    moves = preferred_receptacles(triples, to, "bad_o").where("bad_o <> o").select(*SPO, F.lit(2).alias("rank"), F.lit("receptacle_substitution").alias("how"), "bad_o")
    wrong = changed.unionByName(moves).repartition(n, "s", "p", "bad_o")
    false = wrong.join(rows.withColumnRenamed("o", "bad_o"), ["s", "p", "bad_o"], "left_anti").repartition(n, *SPO)
    return false.groupBy(*SPO).agg(F.min(F.struct("rank", "bad_o", "how")).alias("x")).select(*SPO, "x.bad_o", "x.how")


def one_hop_claims(triples: DataFrame, rules: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """About n claims, half of them true triples, half corrupted ones; (s, p, o, claimed_o, label).

    Which triples are taken follows the seeded order, so reruns agree (Q1: no duplicates by content).
    """
    n_tasks = tasks_for(triples)
    usable = _usable(triples, n_tasks)
    order = [seeded_order(_key(), seed), "s", "p", "o"]
    right = usable.orderBy(*order).limit(n // 2).select("s", "p", "o", F.col("o").alias("claimed_o"), F.lit("supported").alias("label"))
    bad = corruption_candidates(triples.where(~U.is_degenerate(F.col("p"), F.col("o"))), rules, seed, n_tasks).orderBy(seeded_order(_key(), seed + 1), "s", "p", "o").limit(n - n // 2)
    return right.unionByName(bad.select("s", "p", "o", F.col("bad_o").alias("claimed_o"), F.lit("refuted").alias("label")))


def negation_claims(triples: DataFrame) -> DataFrame:
    """Boolean triples read as negations: a false object supports one, a true object refutes it."""
    rows = triples.dropDuplicates(["s", "p", "o"]).where(U.is_boolean(F.col("o")))
    return rows.withColumn("claimed_o", F.lit("False")).withColumn("label", F.when(U.flip_boolean(F.col("o")) == "True", F.lit("supported")).otherwise(F.lit("refuted")))


def _seeded_choice(key: Column, n: int, seed: int) -> Column:
    """0 to n - 1 (n: 2, 4, 8 or 16) by the first hex digit of the seeded order."""
    return ((F.instr(F.lit("0123456789abcdef"), F.substring(seeded_order(key, seed), 1, 1)) - 1) % n).cast("int")


def conjunction_claims(triples: DataFrame, rules: DataFrame, seed: int = 42) -> DataFrame:
    """Claims of two triples, each with the next of its subject: (s, p, o, p2, o2, mode, label,
    true_o, true_o2).

    Mode 0 claims both as they are; 1 corrupts the first, 2 the second, 3 both. A claim of modes 1 to 3
    that no corruption changes isn't made; one that is changed is refuted. Degenerate triples are no claims.
    """
    n = tasks_for(triples)
    bad = corruption_candidates(triples.where(~U.is_degenerate(F.col("p"), F.col("o"))), rules, seed, n).select("s", "p", "o", "bad_o")
    after = Window.partitionBy("s").orderBy("p", "o")
    both = _usable(triples, n).join(bad, SPO, "left").repartition(n, "s").withColumn("n", F.lead(F.struct("p", "o", "bad_o")).over(after)).where("n is not null")
    mode = _seeded_choice(_key(), 4, seed)
    claimed = lambda true, wrong, modes: F.when(mode.isin(*modes), F.coalesce(wrong, true)).otherwise(true)
    made = both.select(
        "s", "p", claimed(F.col("o"), F.col("bad_o"), (1, 3)).alias("o"), F.col("n.p").alias("p2"), claimed(F.col("n.o"), F.col("n.bad_o"), (2, 3)).alias("o2"),
        mode.alias("mode"), F.col("o").alias("true_o"), F.col("n.o").alias("true_o2"),
    )
    same = (F.col("o") == F.col("true_o")) & (F.col("o2") == F.col("true_o2"))
    return made.where((F.col("mode") == 0) | ~same).withColumn("label", F.when(F.col("mode") == 0, F.lit("supported")).otherwise(F.lit("refuted")))


def with_structure(claims: DataFrame, structure: str, labels: tuple[str, ...]) -> DataFrame:
    """Claims of one structure (column structural) with one of some labels."""
    return claims.where((F.col("structural") == structure) & F.col("label").isin(*labels))


def first_contexts(contexts: DataFrame, n: int) -> DataFrame:
    """The n first contexts in order, of a table (context, ...), with all their rows."""
    return contexts.join(contexts.select("context").distinct().orderBy("context").limit(n), "context", "left_semi")


def context_claims(triples: DataFrame, rules: DataFrame, per_context: int, seed: int = 42) -> DataFrame:
    """One-hop claims of every context (columns key, s, p, o): up to per_context // 2 true and
    corrupted ones each, in the seeded order; (key, s, p, o, claimed_o, label)."""
    usable = checkpointed(triples.where(~U.is_degenerate(F.col("p"), F.col("o"))).select("key", *SPO).distinct())  # read five times below
    bad = corruption_candidates(usable.select("s", "p", "o"), rules, seed).select("s", "p", "o", F.col("bad_o").alias("claimed_o"))
    both = usable.select("*", F.col("o").alias("claimed_o"), F.lit("supported").alias("label")).unionByName(usable.join(bad, ["s", "p", "o"]).withColumn("label", F.lit("refuted")))
    ranked = _ranked(both.withColumn("_key", F.concat_ws("|", "s", "p", "o", "claimed_o")), "_key", [F.col("key"), F.col("label")], seed)
    return ranked.where(F.col("_place") <= per_context // 2).drop("_key", "_place", "_all")


def absence_claims(universe: DataFrame, present: DataFrame, per_context: int, seed: int = 42) -> DataFrame:
    """Per context, types that it lacks (supported, see absence_draws) and as many that it has (refuted)."""
    key = F.concat_ws("|", "context", "object_type")
    nth = F.row_number().over(Window.partitionBy("context").orderBy(seeded_order(key, seed), "object_type"))
    had = present.select("context", "object_type").distinct().withColumn("_r", nth).where(F.col("_r") <= per_context).drop("_r")
    return absence_draws(universe, present, per_context, seed).withColumn("label", F.lit("supported")).unionByName(had.withColumn("label", F.lit("refuted")))


# The templates of synthetic claims: name, whether it breaks the shortcut from stance to
# verdict, default share, and items (stance, source, type, strength).
TEMPLATES = (
    ("high_trust_supported", False, 0.06, (("supports", "reuters_web_text", "testimony", 0.8), ("supports", "apnews_web_text", "testimony", 0.8))),
    ("low_trust_nee", True, 0.07, (("supports", "social_media_web_text", "testimony", 0.6),)),
    ("high_trust_refuted", False, 0.06, (("refutes", "reuters_web_text", "testimony", 0.8), ("refutes", "apnews_web_text", "testimony", 0.8))),
    ("low_trust_refuted_nee", True, 0.07, (("refutes", "unknown_web", "testimony", 0.5),)),
    ("conflicting", True, 0.07, (("supports", "reuters_web_text", "testimony", 0.8), ("refutes", "apnews_web_text", "testimony", 0.8))),
    ("strong_support_weak_refute", True, 0.09, (("supports", "reuters_web_text", "testimony", 0.8), ("supports", "apnews_web_text", "testimony", 0.8), ("refutes", "social_media_web_text", "testimony", 0.4))),
    ("weak_support_strong_refute", True, 0.09, (("supports", "social_media_web_text", "testimony", 0.6), ("refutes", "reuters_web_text", "testimony", 0.8), ("refutes", "apnews_web_text", "testimony", 0.8))),
    ("weak_vs_weak_nee", True, 0.09, (("supports", "unknown_web", "testimony", 0.5), ("refutes", "social_media_web_text", "testimony", 0.4))),
    ("corroborating_3", False, 0.06, (("supports", "reuters_web_text", "testimony", 0.8), ("supports", "apnews_web_text", "testimony", 0.8), ("supports", "bbc_web_text", "testimony", 0.7))),
    ("perception_direct", False, 0.07, (("supports", "sensor_perception", "perception", 1.0),)),
    ("inference_nee", True, 0.07, (("supports", "academic_pdf", "inference", 0.5), ("supports", "academic_pdf", "inference", 0.5))),
    ("comparison_supported", False, 0.06, (("supports", "reuters_web_text", "comparison_analogy", 0.7), ("supports", "apnews_web_text", "comparison_analogy", 0.7))),
    ("non_apprehension_absent", False, 0.03, (("supports", "sensor_perception", "non_apprehension", 0.8),)),
    ("non_apprehension_refuted", False, 0.04, (("refutes", "sensor_perception", "non_apprehension", 0.8),)),
    ("non_apprehension_weak_nee", True, 0.07, (("not_enough_evidence", "general_web_text", "non_apprehension", 0.6),)),
)


def template_table(spark, shares: dict[str, float] | None = None) -> DataFrame:
    """The templates in order, with the default shares or the given ones (others are left out)."""
    kinds = "ord int, template string, is_shortcut_breaking boolean, share double, items array<struct<stance: string, source_id: string, type: string, strength: double>>"
    given = [(i, name, breaks, share if shares is None else shares.get(name, 0.0), list(items)) for i, (name, breaks, share, items) in enumerate(TEMPLATES)]
    return spark.createDataFrame([x for x in given if x[3] > 0], kinds)


def synthetic_claims(templates: DataFrame, registry: DataFrame, n: int) -> DataFrame:
    """N claims in the templates' shares (template_table), with the items' confidences by
    the registry's trust (source_id, source_trust) and scores and verdict from the formula.

    Scores are made once per template, in joins of the short tables; claims unfold from the templates.
    """
    items = templates.select("template", F.posexplode("items").alias("pos", "i")).select("template", "pos", "i.*").join(registry.select("source_id", "source_trust"), "source_id", "left")
    trust, weight = F.coalesce("source_trust", F.lit(DEFAULT_TRUST)), F.round(lookup(EVIDENCE_WEIGHTS, F.col("type")), 4)
    scored = items.withColumn("ec", formula.evidence_confidence(trust, weight, F.col("strength")))
    score = lambda side: formula.rounded(formula.stance_score(F.col("stance"), F.col("ec"), side), 4)
    made = scored.groupBy("template").agg(score("supports").alias("support"), score("refutes").alias("refute"), F.array_sort(F.collect_list(F.struct("pos", "stance", "source_id", "ec"))).alias("evidence"))
    rows = apportion(templates, n).where("n > 0").select("template", "is_shortcut_breaking", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k"))
    return rows.join(made, "template").select(
        F.format_string("synthetic-%s-%06d", "template", "k").alias("id"), "template", "is_shortcut_breaking", "support", "refute",
        formula.verdict(F.col("support"), F.col("refute")).alias("verdict"), F.transform("evidence", lambda e: e.dropFields("pos")).alias("evidence"),
    )


def _unit(key: Column, salt: str) -> Column:
    """A number above 0 and up to 1 from eight hex digits of a seeded hash, the same in any engine that has md5."""
    return (F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(salt), key.cast("string"))), 1, 8), 16, 10).cast("double") + 1) / float(1 << 32)


def jittered(strength: Column, key: Column, sigma: float = 0.05) -> Column:
    """normal noise from hashes of the key (Box-Muller), so reruns agree; within 0.1 and 1."""
    noise = F.sqrt(-2 * F.log(_unit(key, "a"))) * F.cos(2 * F.pi() * _unit(key, "b"))
    return F.round(F.greatest(F.lit(0.1), F.least(F.lit(1.0), strength + sigma * noise)), 4)


def generation_counts(claims: DataFrame) -> DataFrame:
    """(dim, key, n) of made claims (s, label, how): labels, ways of corruption, types of subjects."""
    return distributions(claims, {"label": F.col("label"), "how": F.when(F.col("how").isNotNull(), F.array("how")), "type": U.entity_type(F.col("s"))})


def generation_rates(claims: DataFrame, n_triples: int) -> DataFrame:
    """One row: claims of either label, corruptions that worked or didn't (label refuted, with and
    without `how`), and the rates in percent; without refuted claims the ratio is null."""
    pct = lambda a, b: F.round(F.coalesce(F.try_divide(100.0 * a, b), F.lit(0.0)), 4)
    made = (F.col("label") == "supported") | F.col("how").isNotNull()
    out = claims.agg(
        F.count_if(F.col("label") == "supported").alias("n_supported"), F.count_if((F.col("label") == "refuted") & made).alias("n_refuted"),
        F.count_if((F.col("label") == "refuted") & ~made).alias("n_failed"),
    )
    s, r, f = F.col("n_supported"), F.col("n_refuted"), F.col("n_failed")
    return out.select("*", pct(r, r + f).alias("corruption_success"), pct(s + r, F.lit(n_triples)).alias("claim_rate"), F.round(F.try_divide(s.cast("double"), r), 4).alias("supported_to_refuted"))


#: Phrases that open a weak item, and a second or later item of a stance.
WEAK_OPENINGS = ("It is said that", "Some claim that", "There are hints that")
CONNECTORS = ("Likewise,", "In addition,", "Another source reports that")


def grounded_items(items: DataFrame, pool: DataFrame, seed: int = 42) -> DataFrame:
    """Adds claim and text to planned items (claim_id, ord, stance, evidence_type, strength).

    A claim's seed is picked by hash among the seeds of its evidence type, so all its items speak
    of the same thing; weak items get a hedging opening, later ones of a stance a connector. pool:
    evidence_type, claim, stance, text (see sources.records.seed_pool).
    """
    numbered = pool.select("evidence_type", "claim").distinct().withColumn("k", F.row_number().over(Window.partitionBy("evidence_type").orderBy("claim")) - 1)
    sizes = numbered.groupBy("evidence_type").agg(F.count("*").alias("size"))
    nth = F.row_number().over(Window.partitionBy("claim_id", "stance").orderBy("ord"))
    planned = items.withColumn("nth", nth).join(sizes, "evidence_type").withColumn("k", F.pmod(F.xxhash64("claim_id", F.lit(seed)), F.col("size")).cast("int"))
    seeded = planned.join(numbered, ["evidence_type", "k"]).join(pool, ["evidence_type", "claim", "stance"], "left")
    pick = lambda phrases: F.element_at(F.array(*map(F.lit, phrases)), (F.pmod(F.xxhash64("claim_id", "ord"), F.lit(len(phrases))) + 1).cast("int"))
    opened = lambda phrases: F.concat(pick(phrases), F.lit(" "), decapitalised(F.col("text")))
    text = F.when(F.col("nth") > 1, opened(CONNECTORS)).when(F.col("strength") < 0.5, opened(WEAK_OPENINGS)).otherwise(F.col("text"))
    return seeded.withColumn("text", text).drop("k", "size", "nth")


def attempts(triples: DataFrame, rules: DataFrame, seed: int = 42) -> DataFrame:
    """(s, p, o, how, label): every usable triple as a claim, and every attempt to corrupt one, with the way or none."""
    n = tasks_for(triples)
    t = _usable(triples, n)
    bad = corruption_candidates(triples.where(~U.is_degenerate(F.col("p"), F.col("o"))), rules, seed, n)
    tried = t.join(bad.select(*SPO, "how"), SPO, "left").withColumn("label", F.lit("refuted"))
    return t.withColumn("how", F.lit(None).cast("string")).withColumn("label", F.lit("supported")).unionByName(tried)


def build_stats(triples: DataFrame, member: str = "hasObject") -> DataFrame:
    """One row: triples, subjects, predicates, objects in contexts, contexts."""
    is_member = U.relation_name(F.col("p")) == member
    return triples.agg(
        F.count("*").alias("n"), F.count_distinct("s").alias("n_subjects"), F.count_distinct("p").alias("n_predicates"),
        F.count_distinct(F.when(is_member, F.col("o"))).alias("n_objects"), F.count_distinct(F.when(is_member, F.col("s"))).alias("n_contexts"),
    )
