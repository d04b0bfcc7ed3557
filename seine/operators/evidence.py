"""Evidence: atoms, their occurrences, and the assertions they support, under published runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seine.functions.scalars import canonical_set, parse_subject
from seine.operators.paging import keyset_page

PAGE_KEYS = ["predicate", "subject", "object", "assertion_id", "run_id"]
REVERSE_KEYS = ["lineage", "subject", "assertion_id"]


def latest_per(df: DataFrame, scope: list[str], order: list[Column]) -> DataFrame:
    """The first row of every scope in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*scope).orderBy(*order))).where("_n = 1").drop("_n")


def latest_published(runs: DataFrame, scope: list[str]) -> DataFrame:
    """Newest published run of each scope; ties by run id."""
    return latest_per(runs.where("status = 'published' AND published_at IS NOT NULL"), scope, [F.desc("published_at"), F.asc("run_id")])


def latest_attempt(runs: DataFrame, scope: list[str]) -> DataFrame:
    return latest_per(runs.where("started_at IS NOT NULL"), scope, [F.desc("started_at"), F.asc("run_id")])


def visible(assertions: DataFrame, runs: DataFrame, quarantined: DataFrame | None = None) -> DataFrame:
    """Assertions of published runs that are not quarantined."""
    out = assertions.join(runs.where("status = 'published'").select("run_id"), "run_id", "left_semi")
    return out if quarantined is None else out.join(quarantined.select("run_id"), "run_id", "left_anti")


def list_assertions(
    assertions: DataFrame, predicate: str | None = None, subject: str | None = None, object: str | None = None, object_prefix: str | None = None,
    lineage: str | None = None, runs: DataFrame | None = None, limit: int = 50, cursor: list | None = None,
) -> DataFrame:
    """A keyset page of assertions (one probe row beyond the limit)."""
    out = assertions
    for name, value in (("predicate", predicate), ("subject", subject), ("object", object), ("lineage", lineage)):
        if value is not None:
            out = out.where(F.col(name) == value)
    if object_prefix is not None:
        out = out.where(F.col("object").startswith(object_prefix))
    if runs is not None:
        out = visible(out, runs)
    return keyset_page(out, [k for k in PAGE_KEYS if k in out.columns], limit, cursor)


def reverse_assertions(assertions: DataFrame, predicate: str, object: str | DataFrame, limit: int = 50, cursor: list | None = None) -> DataFrame:
    """Who points at an object, in lineage, subject, id order; the object may also be a frame of one row and one column."""
    rows = assertions.where(F.col("predicate") == predicate)
    if isinstance(object, DataFrame):
        rows = rows.join(F.broadcast(object.limit(1).toDF("object")), "object", "left_semi")
    else:
        rows = rows.where(F.col("object") == object)
    return keyset_page(rows, REVERSE_KEYS, limit, cursor)


def normalize_batch(rows: DataFrame, key: list[str], attributes: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows once per key, keys delivered with conflicting attributes)."""
    image = F.sha2(F.to_json(F.struct(*attributes), {"ignoreNullFields": "false"}), 256)
    marked = rows.select(*key, *attributes, image.alias("_image"))
    conflicts = marked.groupBy(*key).agg(F.countDistinct("_image").alias("versions")).where("versions > 1")
    return marked.dropDuplicates([*key, "_image"]).join(conflicts, key, "left_anti").drop("_image"), conflicts


def merge_assertions(rows: DataFrame, key: str, supporting: str, contradicting: str) -> DataFrame:
    """Union of references per assertion, canonical, and whether the two sides overlap.

    References are spread and reduced to distinct ones before they are gathered, so repeats are not carried along.
    """
    none = F.array().cast("array<string>")

    def tagged(column: str, side: int) -> Column:
        return F.transform(F.coalesce(F.col(column), none), lambda x: F.struct(F.lit(side).alias("side"), x.alias("ref")))

    sides = F.concat(tagged(supporting, 0), tagged(contradicting, 1))
    spread = rows.select(F.col(key), F.explode_outer(sides).alias("r")).select(key, "r.side", "r.ref").distinct()

    def union(side: int) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("ref"))))

    out = spread.groupBy(key).agg(union(0).alias("supporting"), union(1).alias("contradicting"))
    return out.withColumn("overlapping", F.arrays_overlap("supporting", "contradicting"))


def references(assertions: DataFrame) -> DataFrame:
    """Distinct (run_id, atom_id) that any assertion rests on or is contradicted by."""
    both = F.concat(F.coalesce("supporting", F.array().cast("array<string>")), F.coalesce("contradicting", F.array().cast("array<string>")))
    return assertions.select("run_id", F.explode(both).alias("atom_id")).distinct()


def proof_evidence(assertions: DataFrame, atoms: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Atoms and their placements behind a set of assertions, each once."""
    return references(assertions).join(occurrences, ["run_id", "atom_id"]).join(atoms, "atom_id")


def incomplete(assertions: DataFrame, occurrences: DataFrame) -> DataFrame:
    """References that no occurrence backs; must be empty for a proof to stand."""
    return references(assertions).join(occurrences.select("run_id", "atom_id").distinct(), ["run_id", "atom_id"], "left_anti")


def resolve_atom(occurrences: DataFrame, atoms: DataFrame, runs: DataFrame, atom_id: str, limit: int = 100) -> DataFrame:
    """Placements of one atom in published runs, bounded, in order."""
    found = visible(occurrences.where(F.col("atom_id") == atom_id), runs).join(atoms, "atom_id")
    return found.orderBy("repo", "path", "start_line", "occurrence_id").limit(limit)


def exact_locator(assertions: DataFrame, occurrences: DataFrame) -> DataFrame:
    """For each assertion its first atom whose placement is exactly the subject ``path:start-end``."""
    located = assertions.select("assertion_id", "run_id", "repo", parse_subject(F.col("subject")).alias("at"), F.explode("supporting").alias("atom_id"))
    on = ["run_id", "repo", "atom_id", "path", "start_line", "end_line"]
    hits = located.select("assertion_id", "run_id", "repo", "atom_id", "at.*").join(occurrences, on)
    return latest_per(hits, ["assertion_id"], [F.asc("atom_id"), F.asc("occurrence_id")])


def impact_rows(assertions: DataFrame, occurrences: DataFrame, fresh_runs: DataFrame) -> DataFrame:
    """assertion x supporting reference x placement x freshness, once per (run, assertion, atom, occurrence)."""
    # repeats are removed where the rows already lie together by run and atom
    spread = assertions.select("assertion_id", "run_id", "predicate", "tier", "lineage", "domain", F.explode(F.array_distinct("supporting")).alias("atom_id"))
    fresh = fresh_runs.groupBy("run_id").agg(F.bool_or("fresh").alias("fresh"))
    placed = spread.join(occurrences, ["run_id", "atom_id"]).dropDuplicates(["run_id", "atom_id", "assertion_id", "occurrence_id"])
    return placed.join(fresh, "run_id", "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))


def assertion_kind(predicate: Column, tier: Column, domain: Column, lineage: Column) -> Column:
    """Partition of an impact row: abstention, matching or resolved."""
    unresolved = predicate.startswith("UNRESOLVED_") | (tier == "unresolved")
    calls = predicate == "CALLS_OPERATION"
    proven = domain.endswith("-caller") & (F.coalesce(lineage, F.lit("")) != "")
    return F.when(unresolved, "abstention").when(calls & ~proven, "matching").otherwise("resolved")


def most_repeated(df: DataFrame, key: str) -> DataFrame:
    """Largest number of rows that share a key."""
    return df.groupBy(key).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"))
