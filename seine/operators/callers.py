"""Caller maps, the contract catalog, bindings between code symbols and declarations, and the work derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seine.functions.scalars import parse_subject, under_prefix
from seine.operators.analytics import set_digest
from seine.vocab import PROTOCOLS


def protocol_of(domain: Column) -> Column:
    """Protocol of an extraction domain, null for those of none."""
    out = None
    for name, protocol in PROTOCOLS.items():
        out = F.when(domain == name, protocol) if out is None else out.when(domain == name, protocol)
    return out


def filter_callers(
    callers: DataFrame, path_prefix: str | None = None, roles: list[str] | None = None, tiers: list[str] | None = None, fresh: bool | None = None,
    resolution: str | None = None, unit: str | None = None, owner: str | None = None,
) -> DataFrame:
    """Caller rows by path prefix, code role, tier, freshness, resolution, and any of their units (array of unit, owner)."""
    out = callers
    if path_prefix:
        out = out.where(under_prefix(F.col("path"), path_prefix))
    for column, values in (("code_role", roles), ("tier", tiers)):
        if values:
            out = out.where(F.col(column).isin(*values))
    if fresh is not None:
        out = out.where(F.col("fresh") == fresh)
    if resolution:
        out = out.where(F.col("resolution") == resolution)
    if unit or owner:
        want = lambda u: (F.lit(True) if not unit else u["unit"] == unit) & (F.lit(True) if not owner else u["owner"] == owner)
        out = out.where(F.exists("units", want))
    return out


def caller_order(grouped: bool = False) -> list[Column]:
    return [*([F.asc_nulls_last("unit_group")] if grouped else []), F.asc("repo"), F.asc("path"), F.asc("start_line"), F.asc("caller_id")]


def contract_problems(records: DataFrame) -> DataFrame:
    """(caller_id, problem) for caller records that contradict themselves: tier, role, unit and predicate must agree."""
    unresolved = F.col("predicate").startswith("UNRESOLVED_")
    checks = {
        "unresolved_with_target": unresolved & F.col("operation").isNotNull(),
        "resolved_without_target": ~unresolved & F.col("operation").isNull(),
        "unresolved_tier_mismatch": unresolved != (F.col("tier") == "unresolved"),
        "unknown_role": ~F.col("code_role").isin("production", "test", "mock", "generated", "vendor"),
        "bad_span": parse_subject(F.col("subject"))["path"].isNull() | (parse_subject(F.col("subject"))["start_line"] >= parse_subject(F.col("subject"))["end_line"]),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))
    return records.select("caller_id", F.explode(found).alias("problem"))


def record_counts(records: DataFrame, leaf: list[str]) -> DataFrame:
    """Resolved and abstained records per leaf."""
    abstained = F.col("predicate").startswith("UNRESOLVED_")
    return records.groupBy(*leaf).agg(F.count_if(~abstained).alias("resolved"), F.count_if(abstained).alias("abstained"), F.count("*").alias("records"))


def leaf_outcomes(files: DataFrame, facts: DataFrame) -> DataFrame:
    """What a file's execution yields: an excluded test, an abstention, its facts, or that it has no direct caller.

    ``files``: path, role, lane (supported, unsupported, oversized). ``facts``: path.
    """
    counted = facts.groupBy("path").agg(F.count("*").alias("facts"))
    rows = files.join(counted, "path", "left").withColumn("facts", F.coalesce("facts", F.lit(0)))
    outcome = F.when(F.col("role") == "test", "excluded_test").when(F.col("lane") != "supported", F.concat(F.lit("abstained_"), F.col("lane"))).when(F.col("facts") > 0, "facts").otherwise("no_direct_caller")
    return rows.select("path", outcome.alias("outcome"), F.when(outcome == "facts", F.col("facts")).otherwise(0).alias("facts"))


def candidate_planes(files: DataFrame, policies: dict[str, Column]) -> DataFrame:
    """(path, plane) for every policy that admits a file."""
    admitted = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in policies.items()]))
    return files.select("path", F.explode(admitted).alias("plane"))


def plane_totals(planes: DataFrame, primary: Column) -> DataFrame:
    """Planned, required and supporting files per plane."""
    return planes.groupBy("plane").agg(F.count("*").alias("planned"), F.count_if(primary).alias("required"), F.count_if(~primary).alias("supporting"))


# the contract catalog


def operation_relationships(operation: str, service: str, lineage: str, facts: DataFrame) -> DataFrame:
    """Everything known about one operation, each row with its kind, class and reason.

    ``facts``: domain, predicate, object, lineage, subject, repo.
    """
    d, p, o = F.col("domain"), F.col("predicate"), F.col("object")
    consumer, caller = d.endswith("-consumer"), d.endswith("-caller")
    proven = F.col("lineage") == lineage
    unproven = F.lit("DECLARATION_LINEAGE_UNPROVEN")
    unresolved = F.lit("OPERATION_DECLARATION_UNRESOLVED")
    none = F.lit(None).cast("string")

    def row(kind: str, klass: Column | str, reason: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), (F.lit(klass) if isinstance(klass, str) else klass).alias("classification"), reason.alias("reason"))

    shape = (
        F.when(consumer & p.startswith("REGISTERS_") & (o == service), row("implementation", F.when(proven, "resolved_implementation").otherwise("matching_registration_evidence"), F.when(proven, none).otherwise(unproven)))
        .when(caller & (p == "CALLS_OPERATION") & (o == operation) & proven, row("caller", "resolved_caller", none))
        .when(consumer & (p == "CALLS_OPERATION") & (o == operation), row("caller", "unresolved_name_match", unproven))
        .when((consumer | caller) & p.startswith("UNRESOLVED_") & (o == operation), row("unresolved_candidate", "extractor_abstention", unresolved))
    )
    return facts.withColumn("_r", shape).where("_r IS NOT NULL").select("repo", "domain", "subject", "_r.*")


def catalog_page(operations: DataFrame, limit: int, scan_most: int, after: tuple | None = None) -> DataFrame:
    """Operations protocol by protocol, repository by repository. The scan budget cuts before the display limit and says so."""
    order = ["protocol", "repo", "service", "operation"]
    from seine.operators.paging import after as beyond

    rows = operations if after is None else operations.where(beyond(order, list(after)))
    scanned = rows.orderBy(*order).limit(scan_most + 1)
    place = Window.orderBy(*order)  # over the bounded scan only
    numbered = scanned.select("*", F.row_number().over(place).alias("_n"), F.count("*").over(Window.partitionBy()).alias("_all"))
    reason = F.when(F.col("_all") > scan_most, "scan_budget").when(F.col("_all") > limit, "page_limit")
    return numbered.withColumn("truncation", reason).where((F.col("_n") <= limit) & (F.col("_n") <= scan_most)).drop("_n", "_all")


def field_references(wanted: DataFrame, assertions: DataFrame, evidence: DataFrame) -> DataFrame:
    """(field_id, assertion_id, path, line, complete): requested fields with the assertions on them and their evidence.

    A missing piece of evidence keeps the row with ``complete`` false, so a caller can refuse the answer.
    """
    hits = wanted.join(assertions.select("assertion_id", F.col("object").alias("field_id"), "supporting"), "field_id")
    spread = hits.select("field_id", "assertion_id", F.explode("supporting").alias("atom_id"))
    return spread.join(evidence.select("atom_id", "path", "line"), "atom_id", "left").select("field_id", "assertion_id", "atom_id", "path", "line", F.col("path").isNotNull().alias("complete"))


# bindings between symbols and declarations


def bind_generated(occurrences: DataFrame, anchors: DataFrame, generated_from: DataFrame, declarations: DataFrame) -> DataFrame:
    """Symbol uses bound to declared fields or operations, only where every step has exactly one answer.

    ``occurrences``: symbol, path, line. ``anchors``: symbol, generated_path, member. ``generated_from``: generated_path, declaration_path.
    ``declarations``: declaration_path, member, object.
    """
    def only(df: DataFrame, key: list[str], value: str) -> DataFrame:
        return df.groupBy(*key).agg(F.count_distinct(value).alias("_n"), F.min(value).alias(value)).where("_n = 1").drop("_n")

    members = anchors.groupBy("symbol").agg(F.count_distinct("generated_path", "member").alias("_n"), F.min("generated_path").alias("generated_path"), F.min("member").alias("member")).where("_n = 1").drop("_n")
    bound = members.join(only(generated_from, ["generated_path"], "declaration_path"), "generated_path").join(only(declarations, ["declaration_path", "member"], "object"), ["declaration_path", "member"])
    return occurrences.join(bound.select("symbol", "object"), "symbol", "left").select("symbol", "path", "line", "object", F.when(F.col("object").isNotNull(), "exact").otherwise("unresolved").alias("tier"))


def reference_facts(bound: DataFrame, predicate: str) -> DataFrame:
    """Facts of bound uses, one per (object, path, line)."""
    return bound.where("object IS NOT NULL").select(F.lit(predicate).alias("predicate"), F.concat("path", F.lit(":"), F.col("line").cast("string"), F.lit("-"), F.col("line").cast("string")).alias("subject"), "object", "tier").distinct()


def attribute_units(sites: DataFrame, units: DataFrame) -> DataFrame:
    """Analysis units of each site: those whose path claim is the longest ancestor of its path; several stay candidates."""
    from seine.functions.scalars import ancestors

    spread = sites.select("site_id", "path", F.posexplode(ancestors(F.col("path"))).alias("depth", "prefix"))
    hits = spread.join(units.select(F.col("path").alias("prefix"), "unit"), "prefix")
    best = hits.groupBy("site_id").agg(F.max("depth").alias("depth"))
    found = hits.join(best, ["site_id", "depth"]).groupBy("site_id").agg(F.array_sort(F.collect_set("unit")).alias("units"))
    state = F.when(F.col("units").isNull(), "unattributed").when(F.size("units") == 1, "resolved").otherwise("ambiguous")
    return sites.select("site_id").join(found, "site_id", "left").select("site_id", F.coalesce("units", F.array().cast("array<string>")).alias("units"), state.alias("attribution"))


def hydrate(references: DataFrame, projections: DataFrame, evidence: DataFrame) -> DataFrame:
    """References with their projection and evidence, in reference order; what is missing stays null."""
    return references.join(projections, "projection_digest", "left").join(evidence, "evidence_digest", "left").orderBy("position")


def first_source_wins(rows: DataFrame, key: str, value: str, source: str) -> DataFrame:
    """Per key the value of the lowest source."""
    return rows.groupBy(key).agg(F.min_by(value, F.struct(source, value)).alias(value))


def version_fence(found: DataFrame, bound: DataFrame) -> DataFrame:
    """Results of the bound commit of their repository only."""
    return found.join(bound.select("repo", "commit").distinct(), ["repo", "commit"], "left_semi")


# suggested work


def suggestions(impact: DataFrame, coverage: DataFrame) -> DataFrame:
    """(kind, subject) suggestions: resolved rows to change, matching ones to confirm, abstentions to investigate, gaps to close."""
    kind = F.when(F.col("class") == "resolved", F.when(F.col("owned"), "update_caller").otherwise("notify_owner")).when(F.col("class") == "matching", "confirm_match").otherwise("investigate")
    rows = impact.select(kind.alias("kind"), "subject")
    gaps = coverage.where(F.col("state").isin("stale", "failed", "processing", "unsupported")).select(F.concat(F.lit("close_gap_"), F.col("state")).alias("kind"), F.concat_ws("/", "repo", "domain").alias("subject"))
    return rows.unionByName(gaps).distinct()


def workbench(planes: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """Rows of several planes in one page, tagged."""
    out = None
    for name, rows in planes.items():
        tagged = rows.select(F.lit(name).alias("plane"), *columns)
        out = tagged if out is None else out.unionByName(tagged)
    return out


def unsupported_histogram(observations: DataFrame) -> DataFrame:
    """Observed files and the reasons why others were not."""
    return observations.groupBy("state", "reason").agg(F.count("*").alias("files"))


def seal(items: DataFrame, name: str, digest: str) -> DataFrame:
    """Manifest digest over (name, digest) pairs; signing happens elsewhere."""
    return set_digest(items, F.concat_ws(" ", F.col(digest), F.col(name)), "items", "manifest")


def verify_seal(sealed: DataFrame, items: DataFrame, name: str, digest: str) -> DataFrame:
    """The sealed count, the count now, and whether the items are those that were sealed. One row against one row."""
    now = seal(items, name, digest).select(F.col("items").alias("items_now"), F.col("manifest").alias("manifest_now"), F.lit(1).alias("one"))
    joined = sealed.withColumn("one", F.lit(1)).join(now, "one")
    return joined.select("items", "items_now", ((F.col("items") == F.col("items_now")) & (F.col("manifest") == F.col("manifest_now"))).alias("intact"))
