"""Code-evidence graphs derived from the driver's tables: a star graph of orders and parts, and a graph of documents' lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.operators.metrics import ACTUAL, TRUTH, Tables, has, sides
from evispark.schema import ENTITIES, FILES, RELATIONS, conform
from evispark.session import table
from evispark.sources.parsers import Markup, parsed

KIND_OF_PRIORITY = {"1-URGENT": "component", "2-HIGH": "class", "3-MEDIUM": "function", "5-LOW": "method", "4-NOT SPECIFIED": "property"}
KIND_OF_FLAG = {"R": "references", "A": "calls", "N": "imports"}


def mapped(column: str, values: dict[str, str]):
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col(column)]


def star_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each customer, in a folder of its nation in a folder of its region."""
    held = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    text = lambda c: F.col(c).cast("string")
    path = F.concat(F.lit("r"), text("n_regionkey"), F.lit("/n"), text("n_nationkey"), F.lit("/c"), text("c_custkey"), F.lit("."), F.lower("c_mktsegment"))
    shaped = held.select(path.alias("path"), F.lower("c_mktsegment").alias("language"), F.lit(True).alias("is_candidate"), (F.col("c_acctbal") >= 0).alias("is_indexed"), F.col("c_custkey").alias("seq"))
    return conform(shaped, FILES)


def order_id(key: Column) -> Column:
    return F.concat(F.lit("order:"), key.cast("string"))


def order_name(key: Column) -> Column:
    return F.concat(F.lit("Order#"), (key % 97).cast("string"))


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders with their customer's file (path, language)."""
    files = star_files(spark, sf_dir).select("path", "language", F.col("seq").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(files, "o_custkey")


def star_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entity for each order, in its customer's file."""
    name = order_name(F.col("o_orderkey"))
    shaped = order_files(spark, sf_dir).select(
        order_id(F.col("o_orderkey")).alias("id"), mapped("o_orderpriority", KIND_OF_PRIORITY).alias("kind"), name.alias("name"),
        F.concat("path", F.lit("::"), name).alias("qualified_name"), F.col("path").alias("file_path"), "language", F.lit("graph").alias("provenance"), F.col("o_orderkey").alias("seq"),
    )
    return conform(shaped, ENTITIES)


def star_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relation for each line of an order, to its part; l_discount and l_tax tell its sides.

    Lines meet their parts before their orders, and what joins them are numbers: texts of orders are made behind the joins.
    """
    rest = F.col("l_suppkey") % 10
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_returnflag", F.when(rest == 0, "external").when(rest == 1, "unresolved").otherwise("internal").alias("resolution"),
        sides(F.col("l_discount") < 0.09, F.col("l_tax") < 0.07).alias("sides"),
    )
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    orders = order_files(spark, sf_dir).select(F.col("o_orderkey").alias("l_orderkey"), "path")
    held, key = lines.join(parts, "l_partkey").join(orders, "l_orderkey"), F.col("l_orderkey")
    return held.select(
        mapped("l_returnflag", KIND_OF_FLAG).alias("kind"), order_id(key).alias("source"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("target"),
        F.concat("path", F.lit("::"), order_name(key)).alias("source_name"), F.col("p_name").alias("target_name"),
        F.col("path").alias("file_path"), "resolution", F.lit("graph").alias("provenance"), key.alias("seq"), "sides",
    )


def star_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, source, target, seq): star_relations as a set of edges, without what their ends are called."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"))
    source, target = (F.concat(F.lit(kind), F.col(key).cast("string")) for kind, key in (("order:", "l_orderkey"), ("part:", "l_partkey")))
    edges = lines.join(parts, "l_partkey", "left_semi").select(mapped("l_returnflag", KIND_OF_FLAG).alias("kind"), source.alias("source"), target.alias("target"), F.col("l_orderkey").alias("seq"))
    return edges.join(star_entities(spark, sf_dir).select(F.col("id").alias("source")), "source", "left_semi").select("kind", "source", "target", "seq")


def star_part_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts as entities without a file, but for every seventh, which no entity stands for."""
    held = table(spark, sf_dir, "part").where("p_partkey % 7 <> 0")
    shaped = held.select(
        F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.lit("external_symbol").alias("kind"), F.col("p_name").alias("name"), F.col("p_name").alias("qualified_name"),
        F.lit("").alias("file_path"), F.lit("none").alias("language"), F.lit("graph").alias("provenance"), (F.col("p_partkey") + (1 << 40)).alias("seq"),
    )
    return conform(shaped, ENTITIES)


def star_sides(spark: SparkSession, sf_dir: str) -> Tables:
    """Two observations in one set of tables, over the same files and entities: two overlapping halves of the relations; truth lacks every fifth entity and actual every seventh."""
    entities = star_entities(spark, sf_dir).withColumn("sides", sides(F.col("seq") % 7 != 0, F.col("seq") % 5 != 0))
    return Tables(entities, conform(star_relations(spark, sf_dir), RELATIONS + ", sides tinyint"), star_files(spark, sf_dir))


def star_observations(spark: SparkSession, sf_dir: str) -> tuple[Tables, Tables]:
    """(actual, truth): star_sides as two observations of their own."""
    both = star_sides(spark, sf_dir)
    return tuple(Tables(conform(both.entities.where(has(side)), ENTITIES), conform(both.relations.where(has(side)), RELATIONS), both.files) for side in (ACTUAL, TRUTH))


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each document; labelled ones are indexed."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("labelled"))
    path = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".txt"))
    held = docs.select("doc_id", path.alias("path"), F.col("lang").alias("language")).join(labels, "doc_id", "left")
    return held.select("path", "language", F.lit(True).alias("is_candidate"), F.coalesce("labelled", F.lit(False)).alias("is_indexed"), F.col("doc_id").alias("seq"))


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, qualified_name, file_path, language, text, seq): a line's first two words, in lower case."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".txt"))
    lines = docs.select("doc_id", path.alias("file_path"), F.col("lang").alias("language"), F.posexplode(F.split("text", "\n")).alias("line", "body"))
    words = F.split("body", " ")
    name, called = F.lower(F.coalesce(F.get(words, F.lit(0)), F.lit(""))), F.lower(F.coalesce(F.get(words, F.lit(1)), F.lit("")))
    seq = F.col("doc_id") * 1_000_000 + F.col("line")
    return lines.select(F.concat(F.lit("line:"), seq.cast("string")).alias("id"), name.alias("name"), F.concat("file_path", F.lit("::"), name).alias("qualified_name"), "file_path", "language", called.alias("text"), seq.alias("seq"))


class Pages(Markup):
    """Pages as sources: navigation is a namespace whose links call what their first word names, the article is a struct with
    the advertisement before it as its decorator, its headline a method and the footer a function."""

    types = {"nav": "namespace_declaration", "article": "struct_declaration", "h1": "method_definition", "footer": "function_declaration", "a": "call_expression", "div": "decorator"}
    named, calling = ("h1", "footer"), ("a",)


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content, seq): a file for each page."""
    path = F.concat(F.col("page_id").cast("string"), F.lit("/"), F.col("url"))
    return table(spark, sf_dir, "pages").select(path.alias("path"), F.col("html").alias("content"), F.col("page_id").alias("seq"))


def page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(page_files(spark, sf_dir), Pages)
