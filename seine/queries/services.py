"""Service catalog, placement and relationship queries. Systems of ``sites`` are services that claim the folders of their sites."""

from __future__ import annotations

from pyspark.sql import functions as F

from seine.operators import services as S
from seine.registry import Registry
from seine.runtime import table

R = Registry()

_TOP = r"^[^/]+/[^/]+"
_M_SQL = r"""
m AS (SELECT DISTINCT 'r' AS repo, system AS service_key, regexp_extract(path, '^[^/]+/[^/]+') AS path, CASE WHEN path LIKE 'vendor/%' THEN 'shared' WHEN path LIKE 'test/%' THEN 'supporting' WHEN path LIKE 'tools/gen/%' THEN 'generated' ELSE 'primary' END AS role
      FROM sites WHERE path IS NOT NULL AND regexp_matches(path, '^[^/]+/[^/]+') AND wave < 4),
f AS (SELECT DISTINCT 'r' AS repo, path FROM g34 WHERE path IS NOT NULL)
"""


def memberships(spark, sf_dir):
    s = table(spark, sf_dir, "sites").where("wave < 4 AND path IS NOT NULL")
    p = F.col("path")
    role = F.when(p.startswith("vendor/"), "shared").when(p.startswith("test/"), "supporting").when(p.startswith("tools/gen/"), "generated").otherwise("primary")
    return s.select(F.lit("r").alias("repo"), F.col("system").alias("service_key"), F.regexp_extract("path", _TOP, 0).alias("path"), role.alias("role")).where("path <> ''").distinct()


def source_files(spark, sf_dir):
    return table(spark, sf_dir, "g34").where("path IS NOT NULL").select(F.lit("r").alias("repo"), "path").distinct()


@R.query(
    "placement_ancestor_join",
    sql=f"""WITH {_M_SQL}, c AS (SELECT f.path, m.service_key, array_to_string(list_sort(list_distinct(list(m.role))), ',') AS roles FROM f JOIN m ON f.path = m.path OR starts_with(f.path, m.path || '/') GROUP BY ALL)
    SELECT path, service_key, roles, 'accepted' AS placement FROM c UNION ALL SELECT path, NULL, '', 'unclaimed' FROM f WHERE path NOT IN (SELECT path FROM c)""",
)
def placement_ancestor_join(spark, sf_dir):
    return S.placements(source_files(spark, sf_dir), memberships(spark, sf_dir)).select("path", "service_key", F.array_join("roles", ",").alias("roles"), "placement")


@R.query(
    "source_census",
    sql=f"""WITH {_M_SQL}, u AS (SELECT path FROM f WHERE path LIKE 'deploy/%'), owned AS (SELECT DISTINCT f.path FROM f JOIN m ON f.path = m.path OR starts_with(f.path, m.path || '/'))
    SELECT 'both' AS problem, path FROM owned WHERE path IN (SELECT path FROM u)
    UNION ALL SELECT 'neither', path FROM f WHERE path NOT IN (SELECT path FROM owned) AND path NOT IN (SELECT path FROM u)
    UNION ALL SELECT 'unused_claim', m.path FROM (SELECT DISTINCT path FROM m) m WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.path = m.path OR starts_with(f.path, m.path || '/'))""",
)
def source_census(spark, sf_dir):
    files = source_files(spark, sf_dir)
    return S.census(files, memberships(spark, sf_dir), files.where(F.col("path").startswith("deploy/"))).select("problem", "path")


@R.query(
    "service_role_counts",
    sql=f"""WITH {_M_SQL} SELECT service_key, count_if(role = 'primary')::BIGINT AS "primary", count_if(role = 'supporting')::BIGINT AS supporting, count_if(role = 'shared')::BIGINT AS shared, count_if(role = 'generated')::BIGINT AS generated, count_if(role = 'typed')::BIGINT AS typed, count(DISTINCT path) AS paths FROM m GROUP BY service_key""",
)
def service_role_counts(spark, sf_dir):
    return S.role_counts(memberships(spark, sf_dir))


@R.query(
    "catalog_violations",
    sql=f"""WITH {_M_SQL}, k AS (SELECT DISTINCT system AS service_key FROM sites WHERE system <> 'oakum'), roles AS (SELECT service_key, list_distinct(list(role)) AS rs FROM m GROUP BY 1)
    SELECT 'unknown_service' AS rule, service_key AS item FROM (SELECT DISTINCT service_key FROM m WHERE service_key NOT IN (SELECT service_key FROM k))
    UNION ALL SELECT 'accepted_without_primary', k.service_key FROM k LEFT JOIN roles r ON k.service_key = r.service_key WHERE NOT coalesce(list_contains(rs, 'primary'), false)
    UNION ALL SELECT 'fan_out', path FROM m GROUP BY path HAVING count(DISTINCT service_key) > 20""",
)
def catalog_violations(spark, sf_dir):
    services = table(spark, sf_dir, "sites").where("system <> 'oakum'").select(F.col("system").alias("service_key"), F.lit("accepted").alias("disposition")).distinct()
    return S.catalog_violations(services, memberships(spark, sf_dir))


_EDGES_SQL = f"""
{_M_SQL}, e AS (SELECT a.row_id AS edge_id, a.path AS source_path, b.path AS target_path, CASE WHEN a.gate = 3 THEN 'rpc' ELSE 'kafka' END AS kind
  FROM (SELECT row_id, path, object, gate FROM g34 WHERE path IS NOT NULL AND object IS NOT NULL AND split = 'dev') a
  JOIN (SELECT object, min(path) AS path FROM g34 WHERE path IS NOT NULL AND object IS NOT NULL AND split = 'train' GROUP BY object) b ON a.object = b.object),
placed AS (SELECT DISTINCT f.path, m.service_key FROM f JOIN m ON f.path = m.path OR starts_with(f.path, m.path || '/')),
ends AS (SELECT edge_id, kind, service_key, 'source' AS side FROM e JOIN placed ON e.source_path = placed.path UNION SELECT edge_id, kind, service_key, 'target' FROM e JOIN placed ON e.target_path = placed.path),
parts AS (SELECT edge_id, kind, service_key, array_to_string(list_sort(list_distinct(list(side))), ',') AS participation FROM ends GROUP BY ALL)
"""


def _edges(spark, sf_dir):
    g = table(spark, sf_dir, "g34").where("path IS NOT NULL AND object IS NOT NULL")
    target = g.where("split = 'train'").groupBy("object").agg(F.min("path").alias("target_path"))
    kind = F.when(F.col("gate") == 3, "rpc").otherwise("kafka")
    return g.where("split = 'dev'").join(target, "object").select(F.col("row_id").alias("edge_id"), F.lit("r").alias("repo"), F.col("path").alias("source_path"), "target_path", kind.alias("kind"))


def _participation(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    parts = S.participation(edges, S.placements(source_files(spark, sf_dir), memberships(spark, sf_dir)))
    return parts.join(edges.select("edge_id", "kind"), "edge_id")


@R.query("edge_participation", sql=f"WITH {_EDGES_SQL} SELECT edge_id, service_key, participation FROM parts")
def edge_participation(spark, sf_dir):
    return _participation(spark, sf_dir).select("edge_id", "service_key", F.array_join("participation", ",").alias("participation"))


@R.query(
    "relationship_views",
    sql=f"""WITH {_EDGES_SQL} SELECT 'dependencies' AS view, service_key, count(*) AS n FROM parts WHERE kind = 'rpc' AND contains(participation, 'source') GROUP BY ALL
    UNION ALL SELECT 'callers', service_key, count(*) FROM parts WHERE kind = 'rpc' AND contains(participation, 'target') GROUP BY ALL UNION ALL SELECT 'topics', service_key, count(*) FROM parts WHERE kind = 'kafka' GROUP BY ALL
    UNION ALL SELECT 'all', service_key, count(*) FROM parts GROUP BY ALL""",
)
def relationship_views(spark, sf_dir):
    parts = _participation(spark, sf_dir)
    views = [S.relationship_view(parts, v).groupBy("service_key").agg(F.count("*").alias("n")).select(F.lit(v).alias("view"), "service_key", "n") for v in ("dependencies", "callers", "topics", "all")]
    out = views[0]
    for v in views[1:]:
        out = out.unionByName(v)
    return out


@R.query(
    "edge_counterparts",
    sql=f"""WITH {_EDGES_SQL} SELECT a.edge_id, a.service_key, array_to_string(list_sort(list_distinct(list(b.service_key))), ',') AS counterparts FROM ends a JOIN ends b ON a.edge_id = b.edge_id AND a.side <> b.side AND a.service_key <> b.service_key GROUP BY ALL""",
)
def edge_counterparts(spark, sf_dir):
    return S.counterparts(_participation(spark, sf_dir)).select("edge_id", "service_key", F.array_join("counterparts", ",").alias("counterparts"))


@R.query(
    "service_dependency_graph",
    sql=f"""WITH {_EDGES_SQL} SELECT s.service_key AS source_service, t.service_key AS target_service, count(*) AS edges FROM (SELECT DISTINCT edge_id, service_key FROM ends WHERE side = 'source') s JOIN (SELECT DISTINCT edge_id, service_key FROM ends WHERE side = 'target') t ON s.edge_id = t.edge_id GROUP BY ALL""",
)
def service_dependency_graph(spark, sf_dir):
    return S.dependency_graph(_participation(spark, sf_dir))


@R.query(
    "successor_chain",
    sql="""SELECT r.name AS service_key, s AS successor, t.is_archived::VARCHAR AS successor_disposition FROM (SELECT name, unnest([name || '-next', (SELECT min(name) FROM repos)]) AS s FROM repos WHERE is_archived) r LEFT JOIN repos t ON t.name = r.s""",
)
def successor_chain(spark, sf_dir):
    r = table(spark, sf_dir, "repos")
    first = r.agg(F.min("name")).first()[0]
    services = r.select(F.col("name").alias("service_key"), F.when(F.col("is_archived"), "rejected").otherwise("accepted").alias("disposition"), F.array(F.concat("name", F.lit("-next")), F.lit(first)).alias("successors"))
    out = S.successors(services)
    return out.select("service_key", "successor", F.when(F.col("successor_disposition") == "rejected", "true").when(F.col("successor_disposition").isNotNull(), "false").alias("successor_disposition"))
