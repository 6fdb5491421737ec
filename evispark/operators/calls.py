"""Resolution of calls by name.

A call's target is the first entity whose name equals the called text or whose qualified name ends with a dot and
that text. Which entity is first doesn't depend on the call, so candidates are reduced to one row per text before
they meet the calls, and no range join is needed: a call that stands behind its candidate is resolved when it is
met, one before it in a second pass, and one without a candidate names an external symbol. The symbols that an ordered
walk creates on its way are found without walking (see ``symbols``).

A text that very many calls use meets one candidate row; the calls stand on the left of those joins, so adaptive
execution splits their partition where it is skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.functions.keyed import dot_suffixes, last_wins
from evispark.session import cut_lineage

#: Kinds of owners whose calls count for nothing.
SILENT_OWNERS = ("file", "repository", "import")


def calls_of(sites: DataFrame) -> DataFrame:
    """Call sites (owner, owner_kind, owner_name, text, file_path, seq) that name something and have a speaking owner."""
    return sites.where(F.col("text").isNotNull() & (F.col("text") != "") & ~F.col("owner_kind").isin(*SILENT_OWNERS))


def postings(entities: DataFrame) -> DataFrame:
    """(text, id, qualified_name, file_path, seq): every text that an entity (id, name, qualified_name, file_path, seq) can be called by."""
    texts = F.array_distinct(F.concat(F.array("name"), dot_suffixes(F.col("qualified_name"))))
    return entities.where("file_path <> ''").select(F.explode(texts).alias("text"), "id", "qualified_name", "file_path", "seq").where("text <> ''")


def first_of(known: DataFrame) -> DataFrame:
    """(text, first_id, first_name, first_seq): the first entity of each text of postings."""
    held = known.groupBy("text").agg(F.min_by(F.struct("id", "qualified_name"), "seq").alias("v"), F.min("seq").alias("first_seq"))
    return held.select("text", F.col("v.id").alias("first_id"), F.col("v.qualified_name").alias("first_name"), "first_seq")


def candidates(entities: DataFrame) -> DataFrame:
    """(text, first_id, first_name, first_seq): for every text the first entity that it can mean."""
    return first_of(postings(entities))


def resolve(calls: DataFrame, entities: DataFrame) -> DataFrame:
    """Strict resolution, one row per call: ``target`` (null if none), ``resolution`` and the ``pass`` that found it.

    pass: 'visit' for an entity at or before the call, 'forward' for a later one, null for an external symbol.
    """
    return resolve_by(calls, candidates(entities))


def resolve_by(calls: DataFrame, first: DataFrame) -> DataFrame:
    """As resolve, by the candidates of the texts."""
    joined = calls.join(first, "text", "left")
    found = F.col("first_id").isNotNull()
    passed = F.when(found, F.when(F.col("first_seq") <= F.col("seq"), "visit").otherwise("forward"))
    named = joined.withColumns({"target": F.col("first_id"), "target_name": F.coalesce("first_name", "text"), "resolution": F.when(found, "internal").otherwise("unresolved"), "pass": passed})
    return named.drop("first_id", "first_name", "first_seq")


def symbols(calls: DataFrame, entities: DataFrame) -> DataFrame:
    """(text, symbol_seq): the external symbols that calls create when they are met in order.

    A text is open if no entity stands at or before its first call. An open text becomes a symbol unless a longer one
    that ends in it (``a.b`` ends in ``b``) became one before. Longer texts needn't be settled first for that: of the open texts
    that end in a text, the one that is met first becomes a symbol, as no other could have come before it. So the first
    symbol among them is met when the first open one is, and one join settles texts with any number of dots.
    """
    texts = calls.groupBy("text").agg(F.min("seq").alias("met")).join(candidates(entities).select("text", "first_seq"), "text", "left")
    open_ = cut_lineage(texts.where("first_seq IS NULL OR met < first_seq").select("text", "met"))
    longer = open_.select(F.explode(dot_suffixes(F.col("text"))).alias("text"), "met").groupBy("text").agg(F.min("met").alias("longer"))
    return open_.join(longer, "text", "left").where("longer IS NULL OR met < longer").select("text", F.col("met").alias("symbol_seq"))


def resolve_in_order(calls: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations (owner, target, target_name, resolution, seq) as a single walk in order of ``seq`` leaves them.

    Kept from such a walk: external symbols are candidates for later calls, which are then 'internal'; a repeated
    call of an owner overwrites its first; the forward pass rewrites only what is still unresolved, and what it
    rewrites is written last. ``target`` is the entity's id or 'external:' and the symbol's text.
    """
    made = cut_lineage(symbols(calls, entities))
    exact = made.select("text", F.col("symbol_seq").alias("own_seq"))
    reach = made.select(F.explode(F.array_distinct(F.concat(F.array("text"), dot_suffixes(F.col("text"))))).alias("text"), F.col("text").alias("symbol"), "symbol_seq")
    reach = reach.groupBy("text").agg(F.min_by("symbol", "symbol_seq").alias("symbol"), F.min("symbol_seq").alias("symbol_seq"))
    joined = calls.join(candidates(entities), "text", "left").join(exact, "text", "left").join(reach, "text", "left")
    creates = F.col("own_seq") == F.col("seq")
    by_entity = F.col("first_seq").isNotNull() & (F.col("first_seq") <= F.coalesce("symbol_seq", F.col("first_seq")))
    external = lambda text: F.concat(F.lit("external:"), text)
    target = F.when(creates, external(F.col("text"))).when(by_entity, F.col("first_id")).otherwise(external(F.col("symbol")))
    met = joined.select("owner", target.alias("target"), F.col("text").alias("target_name"), F.when(creates, "unresolved").otherwise("internal").alias("resolution"), "seq", "first_id", "first_name")
    walked = last_wins(met, ["owner", "target"])
    forward = (F.col("resolution") == "unresolved") & F.col("first_id").isNotNull()
    late = F.lit(1 << 60).cast("bigint")
    after = walked.select(
        "owner",
        F.when(forward, F.col("first_id")).otherwise(F.col("target")).alias("target"),
        F.when(forward, F.col("first_name")).otherwise(F.col("target_name")).alias("target_name"),
        F.when(forward, "internal").otherwise(F.col("resolution")).alias("resolution"),
        F.when(forward, F.col("seq") + late).otherwise(F.col("seq")).alias("seq"),
    )
    final = last_wins(after, ["owner", "target"])
    return final.withColumn("seq", F.col("seq") % late)
