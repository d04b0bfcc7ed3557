"""Code navigation over tables of symbol occurrences, symbols and relationships, and bounded recursion over types."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seine.operators.paging import smallest
from seine.vocab import REFERENCES_MOST, SHAPE_DEPTH_MOST, SHAPE_FIELDS_MOST, SHAPE_NODES_MOST

#: Stands for the fields beyond a bound; no name of a message or field holds a control character.
_MORE = "\x00more"
LOCATION = ["path", "start_line", "start_col", "end_line", "end_col"]


def at_position(occurrences: DataFrame, path: str, line: int, column: int) -> DataFrame:
    """Symbols whose occurrence covers a position (end exclusive)."""
    begins = (F.col("start_line") < line) | ((F.col("start_line") == line) & (F.col("start_col") <= column))
    ends = (F.col("end_line") > line) | ((F.col("end_line") == line) & (F.col("end_col") > column))
    return occurrences.where((F.col("path") == path) & begins & ends).select("symbol").distinct()


def related(symbols: DataFrame, relationships: DataFrame, flag: str, both_ways: bool) -> DataFrame:
    """The symbols and those one relationship away (never further)."""
    edges = relationships.where(F.col(flag))
    out = symbols.select("symbol").unionByName(symbols.join(edges, "symbol").select(F.col("related").alias("symbol")))
    if both_ways:
        out = out.unionByName(symbols.select(F.col("symbol").alias("related")).join(edges, "related").select("symbol"))
    return out.distinct()


def definitions(symbols: DataFrame, occurrences: DataFrame, relationships: DataFrame) -> DataFrame:
    """First definition of the symbols or of what they are declared to define."""
    wanted = related(symbols, relationships, "is_definition", False)
    return occurrences.where(F.col("roles").bitwiseAND(F.lit(1)) != 0).join(wanted, "symbol", "left_semi").select(*LOCATION).distinct().orderBy(*LOCATION).limit(1)


def find_references(symbols: DataFrame, occurrences: DataFrame, relationships: DataFrame, limit: int = REFERENCES_MOST) -> DataFrame:
    """Places of the symbols and their one-hop relatives, the first ``limit`` and whether there are more."""
    wanted = related(symbols, relationships, "is_reference", True)
    return smallest(occurrences.join(wanted, "symbol", "left_semi"), LOCATION, limit)


def hover(symbols: DataFrame, information: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Documentation of each symbol; an occurrence's own text goes before the symbol's."""
    own = occurrences.where("override_documentation IS NOT NULL").groupBy("symbol").agg(F.min("override_documentation").alias("own"))
    return symbols.join(information, "symbol", "left").join(own, "symbol", "left").select("symbol", F.coalesce("own", "documentation").alias("documentation"))


def expand(edges: DataFrame, roots: DataFrame, depth: int = SHAPE_DEPTH_MOST) -> DataFrame:
    """(root, node, depth, path, stop) reached from the roots along ``edges`` (parent, child), at most ``depth`` steps.

    Each step is one equi-join; ``stop`` is ``cycle`` where a node is its own ancestor, ``depth`` at the bound, else null.
    """
    level = roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth"), F.array("node").alias("path"), F.lit(None).cast("string").alias("stop"))
    out = level
    for d in range(1, depth + 1):
        grown = level.where("stop IS NULL").join(edges.select(F.col("parent").alias("node"), "child"), "node")
        seen = F.array_contains("path", F.col("child"))
        level = grown.select("root", F.col("child").alias("node"), F.lit(d).alias("depth"), F.concat("path", F.array("child")).alias("path"), F.when(seen, "cycle").when(F.lit(d == depth), "depth").alias("stop"))
        out = out.unionByName(level)
    return out


def shape(fields: DataFrame, roots: DataFrame, depth: int = SHAPE_DEPTH_MOST, nodes: int = SHAPE_NODES_MOST, per_message: int = SHAPE_FIELDS_MOST) -> DataFrame:
    """:func:`expand` for message shapes, with every bound visible: a message with more than ``per_message`` fields ends in a row that
    stops with ``fields``, a root with more than ``nodes`` nodes in one that stops with ``nodes`` (their node is null)."""
    place = F.row_number().over(Window.partitionBy("parent").orderBy("child"))
    ranked = fields.select("parent", "child").distinct().withColumn("place", place).where(F.col("place") <= per_message + 1)
    edges = ranked.select("parent", F.when(F.col("place") <= per_message, F.col("child")).otherwise(F.lit(_MORE)).alias("child"))
    found = expand(edges, roots, depth)
    order = Window.partitionBy("root").orderBy("depth", "path")
    cut = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= nodes + 1)
    more, over = F.col("node") == _MORE, F.col("place") > nodes
    return cut.select(
        "root", F.when(~more & ~over, F.col("node")).alias("node"), "depth", "path", F.when(over, "nodes").when(more, "fields").otherwise(F.col("stop")).alias("stop")
    )


def resolve_aliases(aliases: DataFrame, names: DataFrame, depth: int = 8) -> DataFrame:
    """(name, target, state): follow alias -> target; ``resolved``, ``cycle`` or ``depth``."""
    found = expand(aliases.select(F.col("alias").alias("parent"), F.col("target").alias("child")), names.select(F.col("name").alias("node")), depth)
    last = found.groupBy(F.col("root").alias("name")).agg(F.max_by("node", "depth").alias("target"), F.max_by("stop", "depth").alias("stop"))
    return last.select("name", F.when(F.col("stop").isNull(), F.col("target")).alias("target"), F.coalesce("stop", F.lit("resolved")).alias("state"))
