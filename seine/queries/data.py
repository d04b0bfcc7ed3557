"""Queries for the general data-preparation operators (nested records, orphan references)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seine.operators.nested import Leaf, Node, flatten_records, long_form
from seine.operators.orphans import Child, Parent, orphan_counts, orphan_references
from seine.registry import Registry
from seine.runtime import table

R = Registry()

ARTIFACTS = Node("artifacts", True, {"name": "name", "bytes": "bytes", "sha256": "sha256"})
REVISIONS = Node("revisions", True, {"revision": "revision", "tree": "tree", "commit": "commit"})
BUILDS = Node("builds", True, {"ordinal": "ordinal"}, (ARTIFACTS, REVISIONS))
PROFILES = Node("profiles", True, {"profile": "profile", "profile_kind": "kind", "scale": "scale"}, (BUILDS,))
REPRODUCIBILITY = Node("reproducibility", False, {"reproducibility_schema": "schema"}, (PROFILES, BUILDS))
BOOTSTRAP = Node("bootstrap", False, {"source_t111_path": "source_t111_path"})
DERIVED_ROOT = Node("derived_root", False, {"facts_root": "facts_root"})
RECEIPT = (BOOTSTRAP, DERIVED_ROOT, REPRODUCIBILITY)

LEAVES = [
    Leaf("artifact", (REPRODUCIBILITY, PROFILES, BUILDS, ARTIFACTS), "sha256"),
    Leaf("artifact", (REPRODUCIBILITY, BUILDS, ARTIFACTS), "sha256"),
    Leaf("revision", (REPRODUCIBILITY, PROFILES, BUILDS, REVISIONS), "commit"),
    Leaf("revision", (REPRODUCIBILITY, BUILDS, REVISIONS), "commit"),
    Leaf("bootstrap", (BOOTSTRAP,), "source_t111_path"),
    Leaf("derived_root", (DERIVED_ROOT,), "facts_root"),
]


def _opened(x: str) -> str:
    """SQL: a part written as JSON text counts as the part."""
    return f"CASE json_type({x}) WHEN 'VARCHAR' THEN TRY_CAST(json_extract_string({x}, '$') AS JSON) ELSE {x} END"


def _unnested(x: str) -> str:
    """SQL: elements of a list with their positions; a bare object is a list of one."""
    items = f"CASE json_type({x}) WHEN 'ARRAY' THEN json_extract({x}, '$[*]') WHEN 'OBJECT' THEN [{x}] ELSE [] END"
    return f"unnest({items}) AS e, (generate_subscripts({items}, 1) - 1)::INTEGER AS pos"


_P1_SQL = f"""
top AS (SELECT receipt_id, {_opened("payload::JSON")} AS o FROM receipts WHERE json_valid(payload)),
parts AS (SELECT receipt_id, {_opened("o->'$.reproducibility'")} AS rep, {_opened("o->'$.bootstrap'")} AS boot, {_opened("o->'$.derived_root'")} AS derived FROM top),
profile_lists AS (SELECT receipt_id, {_opened("rep->'$.profiles'")} AS x FROM parts), profiles0 AS (SELECT receipt_id, {_unnested("x")} FROM profile_lists),
profiles AS (SELECT receipt_id, pos AS profile_pos, {_opened("e")} AS p FROM profiles0),
build_lists AS (SELECT receipt_id, profile_pos, {_opened("p->'$.builds'")} AS x FROM profiles UNION ALL SELECT receipt_id, -1, {_opened("rep->'$.builds'")} FROM parts),
builds0 AS (SELECT receipt_id, profile_pos, {_unnested("x")} FROM build_lists), builds AS (SELECT receipt_id, profile_pos, pos AS build_pos, {_opened("e")} AS b FROM builds0),
child_lists AS (SELECT receipt_id, profile_pos, build_pos, 'artifact' AS child_kind, {_opened("b->'$.artifacts'")} AS x FROM builds UNION ALL SELECT receipt_id, profile_pos, build_pos, 'revision', {_opened("b->'$.revisions'")} FROM builds),
children0 AS (SELECT receipt_id, profile_pos, build_pos, child_kind, {_unnested("x")} FROM child_lists), children AS (SELECT receipt_id, profile_pos, build_pos, child_kind, pos AS child_pos, {_opened("e")} AS c FROM children0),
leaves AS (
  SELECT receipt_id, profile_pos, build_pos, child_kind, child_pos, CASE child_kind WHEN 'artifact' THEN c->>'$.sha256' ELSE c->>'$.commit' END AS child_value FROM children
  UNION ALL SELECT receipt_id, -1, -1, 'bootstrap', -1, boot->>'$.source_t111_path' FROM parts UNION ALL SELECT receipt_id, -1, -1, 'derived_root', -1, derived->>'$.facts_root' FROM parts)
"""


@R.query("p1_found", sql=f"WITH {_P1_SQL} SELECT * FROM leaves WHERE child_value IS NOT NULL")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    receipts = table(spark, sf_dir, "receipts")
    return long_form(receipts, "payload", ["receipt_id"], LEAVES, {"profile_pos": "profiles", "build_pos": "builds"})


def _receipt_table(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flatten_records(table(spark, sf_dir, "receipts"), "payload", ["receipt_id"], RECEIPT, {name})[name]

    return run


def _fields(x: str, *names: str, **renamed: str) -> str:
    """SQL: fields of the object ``x`` as text."""
    return ", ".join(f"{x}->>'$.{k}' AS {c}" for c, k in [*((n, n) for n in names), *renamed.items()])


_ARTIFACT, _REVISION = _fields("c", "name", "bytes", "sha256"), _fields("c", "revision", "tree", "commit")
_TABLES = {
    "p1_bootstrap": ("bootstrap", f"SELECT receipt_id, {_fields('boot', 'source_t111_path')} FROM parts WHERE json_type(boot) = 'OBJECT'"),
    "p1_derived_root": ("derived_root", f"SELECT receipt_id, {_fields('derived', 'facts_root')} FROM parts WHERE json_type(derived) = 'OBJECT'"),
    "p1_profiles": ("reproducibility.profiles", f"SELECT receipt_id, profile_pos AS profiles_pos, {_fields('p', 'profile', 'scale', profile_kind='kind')} FROM profiles WHERE json_type(p) = 'OBJECT'"),
    "p1_profile_builds": ("reproducibility.profiles.builds", f"SELECT receipt_id, profile_pos AS profiles_pos, build_pos AS builds_pos, {_fields('b', 'ordinal')} FROM builds WHERE profile_pos >= 0 AND json_type(b) = 'OBJECT'"),
    "p1_direct_builds": ("reproducibility.builds", f"SELECT receipt_id, build_pos AS builds_pos, {_fields('b', 'ordinal')} FROM builds WHERE profile_pos < 0 AND json_type(b) = 'OBJECT'"),
    "p1_profile_artifacts": (
        "reproducibility.profiles.builds.artifacts",
        f"SELECT receipt_id, profile_pos AS profiles_pos, build_pos AS builds_pos, child_pos AS artifacts_pos, {_ARTIFACT} FROM children WHERE child_kind = 'artifact' AND profile_pos >= 0 AND json_type(c) = 'OBJECT'",
    ),
    "p1_profile_revisions": (
        "reproducibility.profiles.builds.revisions",
        f"SELECT receipt_id, profile_pos AS profiles_pos, build_pos AS builds_pos, child_pos AS revisions_pos, {_REVISION} FROM children WHERE child_kind = 'revision' AND profile_pos >= 0 AND json_type(c) = 'OBJECT'",
    ),
    "p1_direct_artifacts": ("reproducibility.builds.artifacts", f"SELECT receipt_id, build_pos AS builds_pos, child_pos AS artifacts_pos, {_ARTIFACT} FROM children WHERE child_kind = 'artifact' AND profile_pos < 0 AND json_type(c) = 'OBJECT'"),
    "p1_direct_revisions": ("reproducibility.builds.revisions", f"SELECT receipt_id, build_pos AS builds_pos, child_pos AS revisions_pos, {_REVISION} FROM children WHERE child_kind = 'revision' AND profile_pos < 0 AND json_type(c) = 'OBJECT'"),
}
for _query, (_name, _sql) in _TABLES.items():
    R.query(_query, sql=f"WITH {_P1_SQL} {_sql}")(_receipt_table(_name))


def _references(spark: SparkSession, sf_dir: str) -> list[Child]:
    return [
        Child("g34", table(spark, sf_dir, "g34"), "row_id", "site_id", "observed_at", "sites"),
        Child("g3h2", table(spark, sf_dir, "g3h2"), "row_id", "site_id", "labelled_at", "sites"),
    ]


def _registry(spark: SparkSession, sf_dir: str) -> list[Parent]:
    return [Parent("sites", table(spark, sf_dir, "sites"), "site_id", "registered_at", "deleted_at")]


_REFS_SQL = r"""
refs AS (
  SELECT 'g34' AS ref_table, row_id, trim(site_id, ' ' || chr(9) || chr(10) || chr(13)) AS k, observed_at AS t FROM g34
  UNION ALL
  SELECT 'g3h2', row_id, trim(site_id, ' ' || chr(9) || chr(10) || chr(13)), labelled_at FROM g3h2),
parents AS (SELECT trim(site_id, ' ' || chr(9) || chr(10) || chr(13)) AS k, registered_at AS s, deleted_at AS e FROM sites),
known AS (SELECT DISTINCT k FROM parents WHERE k <> ''),
hit AS (SELECT DISTINCT r.ref_table, r.row_id FROM refs r JOIN parents p ON r.k = p.k AND p.s <= r.t AND (p.e IS NULL OR r.t < p.e)),
begun AS (SELECT DISTINCT r.ref_table, r.row_id FROM refs r JOIN parents p ON r.k = p.k AND p.s <= r.t AND (p.e IS NULL OR p.e > p.s)),
bad AS (
  SELECT r.*, CASE WHEN known.k IS NULL THEN 'missing' WHEN begun.row_id IS NOT NULL THEN 'deleted' ELSE 'not_yet' END AS reason
  FROM refs r LEFT JOIN known ON r.k = known.k
  LEFT JOIN hit ON hit.ref_table = r.ref_table AND hit.row_id = r.row_id
  LEFT JOIN begun ON begun.ref_table = r.ref_table AND begun.row_id = r.row_id
  WHERE r.k <> '' AND CASE WHEN r.t IS NULL THEN known.k IS NULL ELSE hit.row_id IS NULL END)
"""


@R.query("p5_found", sql=f"WITH {_REFS_SQL} SELECT ref_table, row_id FROM bad")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_references(_registry(spark, sf_dir), _references(spark, sf_dir)).select("ref_table", "row_id")


@R.query(
    "p5_counts",
    sql=f"""WITH {_REFS_SQL},
    seen AS (SELECT ref_table, strftime(t AT TIME ZONE 'UTC', '%Y-%m') AS period, count(*) AS n FROM refs WHERE k <> '' GROUP BY ALL),
    lost AS (SELECT ref_table, strftime(t AT TIME ZONE 'UTC', '%Y-%m') AS period, count(*) AS n, count_if(reason = 'missing') AS missing,
                    count_if(reason = 'not_yet') AS not_yet, count_if(reason = 'deleted') AS deleted FROM bad GROUP BY ALL)
    SELECT s.ref_table, s.period, s.n AS n_references, coalesce(l.n, 0)::BIGINT AS n_orphans, coalesce(l.missing, 0)::BIGINT AS missing,
           coalesce(l.not_yet, 0)::BIGINT AS not_yet, coalesce(l.deleted, 0)::BIGINT AS deleted
    FROM seen s LEFT JOIN lost l ON s.ref_table = l.ref_table AND s.period IS NOT DISTINCT FROM l.period""",
)
def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kids = _references(spark, sf_dir)
    return orphan_counts(orphan_references(_registry(spark, sf_dir), kids), kids)
