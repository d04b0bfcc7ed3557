"""One consistent form for texts that look the same but are written with different characters.

Texts of ASCII characters only are already consistent. Every other text is cut into positioned pieces: runs of ASCII, and
clusters of one character with the marks and invisible characters that follow it. The distinct clusters of the whole corpus
form a dictionary; its code points are exploded with their positions, broadcast-joined with the decomposition and look-alike
tables (bounded by Unicode), combining marks are ordered by class, starters recomposed, and the clusters rebuilt. The texts
are rebuilt from their pieces inside the partition that holds the document, so pieces are never shuffled.

What counts as the same: width forms, composed and attached accents, characters that show nothing, the kind of a single
blank, and letters or hyphens that cannot be told apart by eye. Case, missing accents, raised digits, tabs and line ends stay.

Defined behaviour: null stays null, empty stays empty, texts of any length are processed whole; ``canonical_text`` keeps
repeated rows, also of one id with different texts; ``look_alike_pairs`` lists a pair of ids once and no id with itself; extra
columns are ignored; empty tables give empty results; rows with a null id are left out of texts that need rewriting and pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seine.llm.glyphs import FILLERS, compositions, decompositions, look_alikes, mark_classes
from seine.runtime import broadcast_if_small, checkpoint

#: Follows a base character in its cluster.
_ATTACHED = r"[\p{M}\p{Cf}\x{1161}-\x{1175}\x{11A8}-\x{11C2}\x{FF9E}\x{FF9F}" + FILLERS + r"]"
_CONTROL = r"[\x00-\x08\x0E-\x1F\x7F]"
_PIECE = rf"(?:(?!{_CONTROL})[\x00-\x7F])+(?!{_ATTACHED})|[\s\S]{_ATTACHED}*"
_PLAIN = r"^[\x09-\x0D\x20-\x7E]*$"


def _table(spark: SparkSession, rows: dict, schema: str) -> DataFrame:
    """A mapping table; its size is fixed by Unicode (under 30,000 short rows), so it may always be broadcast."""
    return F.broadcast(spark.createDataFrame(list(rows.items()), schema))


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))


def cluster_dictionary(clusters: DataFrame) -> DataFrame:
    """(piece) -> (piece, form) by decomposition, look-alikes, ordering of marks and recomposition."""
    spark = clusters.sparkSession
    apart = _table(spark, decompositions(), "cp string, parts string")
    alike = _table(spark, look_alikes(spark), "ch string, latin string")
    classes = _table(spark, mark_classes(), "ch string, mark_class int")
    composed = _table(spark, compositions(), "cluster string, whole string")

    points = clusters.select("piece", F.posexplode(F.split("piece", "")).alias("pos", "cp"))
    parts = points.join(apart, "cp", "left").select("piece", "pos", F.posexplode(F.split(F.coalesce("parts", "cp"), "")).alias("sub", "ch")).where("ch <> ''")
    mapped = parts.join(alike, "ch", "left").join(classes, "ch", "left")
    # a starter opens a cluster; its marks are ordered by class, ties by position
    per_piece = mapped.groupBy("piece").agg(
        F.array_sort(F.collect_list(F.struct("pos", "sub", F.coalesce("latin", "ch").alias("ch"), F.coalesce("mark_class", F.lit(0)).alias("mark_class")))).alias("xs")
    )
    numbered = per_piece.select(
        "piece",
        F.inline(F.transform("xs", lambda x, i: F.struct(F.size(F.filter(F.slice("xs", 1, i + 1), lambda y: y["mark_class"] == 0)).alias("starter"), x["mark_class"].alias("mark_class"), i.alias("i"), x["ch"].alias("ch")))),
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("mark_class", "i", "ch"))), lambda x: x["ch"]), "")
    grouped = numbered.groupBy("piece", "starter").agg(joined.alias("cluster"), F.min("i").alias("i"))
    whole = grouped.join(composed, "cluster", "left").select("piece", "i", "cluster", "whole")
    # where no character stands for all marks, the first mark that has one is taken in, the others stay attached
    first = whole.select("piece", "i", "whole", F.substring("cluster", 1, 2).alias("head"), F.substring("cluster", 3, 1 << 30).alias("tail"), F.col("cluster").alias("all"))
    pair = first.join(composed.select(F.col("cluster").alias("head"), F.col("whole").alias("two")), "head", "left")
    form = F.coalesce("whole", F.concat("two", "tail"), "all")
    built = pair.groupBy("piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", form.alias("form")))), lambda x: x["form"]), "").alias("form"))
    return clusters.join(built, "piece", "left").select("piece", F.coalesce("form", F.lit("")).alias("form"))


def canonical_text(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, text, canonical) for every row."""
    base = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    plain = F.col("text").isNull() | F.col("text").rlike(_PLAIN)
    odd = base.where(~plain)
    special = ~F.col("piece").rlike(_PLAIN)
    clusters = odd.select(F.explode(F.array_distinct(_pieces(F.col("text")))).alias("piece")).where(special).distinct()
    dictionary = broadcast_if_small(checkpoint(cluster_dictionary(clusters)))
    # the text is moved once, by id; exploding, looking up and rebuilding then stay inside its partition
    moved = odd.select("id", "text", F.md5("text").alias("th")).repartition("id", "th")
    looked_up = moved.dropDuplicates(["id", "th"]).select("id", "th", F.posexplode(_pieces(F.col("text"))).alias("pos", "piece")).join(dictionary, "piece", "left")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("form", "piece").alias("form")))), lambda x: x["form"])
    rebuilt = looked_up.groupBy("id", "th").agg(F.array_join(ordered, "").alias("canonical"))
    return base.where(plain).select("id", "text", F.col("text").alias("canonical")).unionByName(moved.join(rebuilt, ["id", "th"]).select("id", "text", "canonical"))


def _signed(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, form, variant): digests of the consistent form and of the text of every row that has one."""
    forms = canonical_text(df, id_column, text_column).where(F.col("text").isNotNull())
    return checkpoint(forms.select("id", F.md5("canonical").alias("form"), F.md5("text").alias("variant")))


def look_alike_classes(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, class_id, n_variants, n_rows) for every row with a text: the least id of those that look the same, in how many different
    texts and rows. Nothing is expanded into pairs; a row is in a pair if its class has two variants or more."""
    signed = _signed(df, id_column, text_column)
    classes = signed.groupBy("form").agg(F.min("id").alias("class_id"), F.countDistinct("variant").alias("n_variants"), F.count("*").alias("n_rows"))
    return signed.join(classes, "form").select("id", "class_id", "n_variants", "n_rows")


def look_alike_pairs(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Pairs (id_a < id_b) of rows with unequal texts and equal canonical form.

    Copies of one text are first collapsed to a variant; variants of one form are paired, then expanded to their rows, so a
    large group of copies costs no comparisons among its own rows.
    """
    signed = _signed(df, id_column, text_column)
    mixed = signed.groupBy("form").agg(F.min("variant").alias("least"), F.max("variant").alias("most")).where("least <> most").select("form")
    rows = signed.join(mixed, "form", "left_semi").distinct()
    variants = rows.select("form", "variant").distinct()
    pairs = variants.select("form", F.col("variant").alias("va")).join(variants.select("form", F.col("variant").alias("vb")), "form").where("va < vb")
    left = rows.select("form", F.col("variant").alias("va"), F.col("id").alias("ia"))
    right = rows.select("form", F.col("variant").alias("vb"), F.col("id").alias("ib"))
    return pairs.join(left, ["form", "va"]).join(right, ["form", "vb"]).where("ia <> ib").select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).distinct()
