"""Search queries. ``documents`` play the indexed files, ``repos`` the repository table, sites' systems the services."""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seine.io import Generations
from seine.plans import index as X
from seine.plans import search as S
from seine.plans.query_language import parse
from seine.registry import Registry
from seine.runtime import ensure_checkpoint_dir, table

R = Registry()

CONTEXTS = {"freight": ["forge.example/harborlight/*", "forge.example/tidegate/*"], "services": ["forge.example/*/*-svc"]}
_FILES_SQL = "files AS (SELECT doc_id, repo, path, lang AS language, coalesce(text, '') AS content, coalesce(path, '') AS p FROM documents)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "repo", "path", F.col("lang").alias("language"), F.col("text").alias("content"))


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "repos")


def published_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trigram index of the documents: published once per session and data directory in the shared folder, then only read."""
    root = f"{ensure_checkpoint_dir(spark)}/index-{spark.sparkContext.applicationId}-{md5(sf_dir.encode()).hexdigest()}"
    store = Generations(spark, root)
    if store.current() is None:
        store = X.publish(files(spark, sf_dir), "doc_id", root)
    return store.read()


def _search(spark: SparkSession, sf_dir: str, raw: str, max_matches: int | None = None, **scope) -> DataFrame:
    return X.indexed_search(files(spark, sf_dir), published_index(spark, sf_dir), "doc_id", raw, max_matches, **scope)


def _hits(column: str, pattern: str, flags: str = "") -> str:
    return f"len(regexp_extract_all({column}, '{flags}{pattern}'))"


_TOP = "ORDER BY score DESC, repo NULLS FIRST, path NULLS FIRST, language NULLS FIRST, doc_id"
_COLUMNS = ["doc_id", "repo", "path", "language", "score"]


@R.query(
    "search_bool_topk",
    sql=f"""WITH {_FILES_SQL}
    SELECT doc_id, repo, path, language, ({_hits("content", "membership", "(?i)")} + regexp_matches(p, '(?i)membership')::INT)::BIGINT AS score FROM files
    WHERE (regexp_matches(content, '(?i)membership') OR regexp_matches(p, '(?i)membership')) AND lower(coalesce(language, '')) = 'en'
      AND NOT (regexp_matches(content, '(?i)rollback') OR regexp_matches(p, '(?i)rollback')) {_TOP} LIMIT 50""",
)
def search_bool_topk(spark, sf_dir):
    return _search(spark, sf_dir, "membership lang:en -rollback").select(*_COLUMNS)


@R.query(
    "search_not_or_metadata",
    sql=f"""WITH {_FILES_SQL}
    SELECT f.doc_id, f.repo, f.path, f.language, (({_hits("content", "ledger", "(?i)")} + regexp_matches(p, '(?i)ledger')::INT))::BIGINT AS score
    FROM files f LEFT JOIN repos r ON f.repo = r.name
    WHERE (regexp_matches(content, '(?i)ledger') OR regexp_matches(p, '(?i)ledger'))
      AND (coalesce(r.is_archived, false) OR lower(coalesce(f.language, '')) = 'fr') AND NOT coalesce(r.is_fork, false) {_TOP} LIMIT 100""",
)
def search_not_or_metadata(spark, sf_dir):
    return _search(spark, sf_dir, "ledger (archived:yes or lang:fr) -fork:yes", 100, repos=repos(spark, sf_dir)).select(*_COLUMNS)


@R.query(
    "search_context_scope",
    sql=f"""WITH {_FILES_SQL}
    SELECT doc_id, repo, path, language, ({_hits("content", "unit digest", "(?i)")} + regexp_matches(p, '(?i)unit digest')::INT)::BIGINT AS score FROM files
    WHERE (regexp_matches(content, '(?i)unit digest') OR regexp_matches(p, '(?i)unit digest'))
      AND repo IN (SELECT name FROM repos WHERE regexp_matches(name, '^forge\\.example/(harborlight|tidegate)/[^/]*$') OR regexp_matches(name, '^forge\\.example/[^/]*/[^/]*-svc$')) {_TOP} LIMIT 50""",
)
def search_context_scope(spark, sf_dir):
    return _search(spark, sf_dir, 'context:freight context:services "unit digest"', repos=repos(spark, sf_dir), contexts=CONTEXTS).select(*_COLUMNS)


@R.query(
    "search_regex_case_fields",
    sql=f"""WITH {_FILES_SQL}
    SELECT doc_id, repo, path, language, ({_hits("content", "(Watch|List)[A-Z][a-z]+")})::BIGINT AS score FROM files
    WHERE regexp_matches(content, '(Watch|List)[A-Z][a-z]+') AND NOT regexp_matches(p, '(?i)docs/fi') AND coalesce(regexp_matches(repo, '(?i)quillmesh|oakum'), false) {_TOP} LIMIT 50""",
)
def search_regex_case_fields(spark, sf_dir):
    return _search(spark, sf_dir, r"content:(Watch|List)[A-Z][a-z]+ -file:docs/fi repo:quillmesh|oakum").select(*_COLUMNS)


@R.query(
    "search_stats",
    sql=f"""WITH {_FILES_SQL} SELECT count(*) AS file_count, coalesce(sum({_hits("content", "Rotate")} + contains(p, 'Rotate')::INT), 0)::BIGINT AS match_count
    FROM files WHERE contains(content, 'Rotate') OR contains(p, 'Rotate')""",
)
def search_stats(spark, sf_dir):
    return S.search_stats(files(spark, sf_dir), "case:yes Rotate")


@R.query(
    "search_permission",
    sql=f"""WITH {_FILES_SQL} SELECT count(*) AS file_count, coalesce(sum({_hits("content", "beacon", "(?i)")} + regexp_matches(p, '(?i)beacon')::INT), 0)::BIGINT AS match_count
    FROM files WHERE (regexp_matches(content, '(?i)beacon') OR regexp_matches(p, '(?i)beacon')) AND repo IN (SELECT name FROM repos WHERE is_public)""",
)
def search_permission(spark, sf_dir):
    visible = repos(spark, sf_dir).where("is_public").select(F.col("name").alias("repo"))
    return S.search_stats(X.narrowed(files(spark, sf_dir), published_index(spark, sf_dir), "doc_id", "beacon"), "beacon", visible=visible)


@R.query(
    "search_chunks",
    sql=f"""WITH {_FILES_SQL},
    hit AS (SELECT *, ({_hits("content", "schema tag", "(?i)")})::BIGINT AS score FROM files WHERE regexp_matches(content, '(?i)schema tag')),
    top AS (SELECT * FROM hit {_TOP} LIMIT 20),
    lines AS (SELECT doc_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM top)
    SELECT doc_id, n::INTEGER AS start_line, line AS content, len(regexp_extract_all(line, '(?i)schema tag'))::INTEGER AS n_ranges,
           (length(regexp_extract(line, '^(.*?)(?i:schema tag)', 1)) + 1)::INTEGER AS first_col FROM lines WHERE regexp_matches(line, '(?i)schema tag')""",
)
def search_chunks(spark, sf_dir):
    raw = 'content:"schema tag"'
    found = S.chunks(_search(spark, sf_dir, raw, 20), parse(raw))
    rows = found.select("doc_id", F.inline("chunks"))
    return rows.select("doc_id", F.col("start_line").cast("int").alias("start_line"), "content", F.size("ranges").alias("n_ranges"), F.col("ranges")[0]["start_col"].alias("first_col"))


@R.query(
    "search_scope_receipt",
    sql=f"""WITH {_FILES_SQL}, hit AS (SELECT *, ({_hits("content", "resolver entr", "(?i)")} + regexp_matches(p, '(?i)resolver entr')::INT)::BIGINT AS score FROM files WHERE regexp_matches(content, '(?i)resolver entr') OR regexp_matches(p, '(?i)resolver entr')),
    top AS (SELECT coalesce(repo, '') || chr(9) || p || chr(9) || doc_id::VARCHAR AS cite, repo FROM hit {_TOP} LIMIT 500)
    SELECT count(*) AS files, sha256(coalesce(string_agg(cite, chr(10) ORDER BY cite), '')) AS digest, count(DISTINCT repo) AS repositories FROM top""",
)
def search_scope_receipt(spark, sf_dir):
    return S.receipt(_search(spark, sf_dir, '"resolver entr"', 500), "doc_id")


@R.query(
    "service_prefix_search",
    sql=f"""WITH {_FILES_SQL}, claims AS (SELECT DISTINCT repo, regexp_extract(path, '^[^/]+/[^/]+') AS prefix FROM documents
      WHERE source = 'harborlight/docs' AND regexp_matches(path, '^[^/]+/[^/]+'))
    SELECT doc_id, repo, path, language, ({_hits("content", "mirror", "(?i)")} + regexp_matches(p, '(?i)mirror')::INT)::BIGINT AS score FROM files f
    WHERE (regexp_matches(content, '(?i)mirror') OR regexp_matches(p, '(?i)mirror'))
      AND EXISTS (SELECT 1 FROM claims c WHERE c.repo = f.repo AND (f.path = c.prefix OR starts_with(f.path, c.prefix || '/'))) {_TOP} LIMIT 50""",
)
def service_prefix_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    prefix = F.regexp_extract("path", r"^[^/]+/[^/]+", 0)
    claims = docs.where("source = 'harborlight/docs'").select("repo", prefix.alias("path"), F.lit("harborlight").alias("service_key")).where("path <> ''").distinct()
    return _search(spark, sf_dir, "mirror", memberships=claims, service_key="harborlight").select(*_COLUMNS)


@R.query(
    "revision_resolution",
    sql="""WITH rows AS (SELECT name AS repo, indexed_commit, unnest(indexed_revisions) AS r FROM repos),
    flat AS (SELECT repo, indexed_commit, r.selector AS selector, r.branch AS branch, r."commit" AS "commit" FROM rows)
    SELECT repo, selector, branch, "commit", (count(*) OVER (PARTITION BY repo, selector) = 1 AND (selector <> 'HEAD' OR "commit" IS NOT DISTINCT FROM indexed_commit)) AS valid FROM flat""",
)
def revision_resolution(spark, sf_dir):
    return S.indexed_revisions(repos(spark, sf_dir))


@R.query(
    "revision_bound_search",
    sql="""WITH rev AS (SELECT name AS repo, indexed_commit, unnest(indexed_revisions) AS r FROM repos),
    ok AS (SELECT repo, r.branch AS branch, r."commit" AS c FROM rev WHERE r.selector = 'HEAD' AND r."commit" IS NOT DISTINCT FROM indexed_commit),
    bound AS (SELECT * FROM ok WHERE repo IN (SELECT repo FROM rev WHERE r.selector = 'HEAD' GROUP BY repo HAVING count(*) = 1))
    SELECT d.doc_id, d.repo FROM documents d JOIN bound b ON d.repo = b.repo JOIN repos p ON p.name = d.repo
    WHERE b.branch = 'main' AND b.c = p.indexed_commit AND (contains(coalesce(d.text, ''), 'Settle') OR contains(coalesce(d.path, ''), 'Settle'))""",
)
def revision_bound_search(spark, sf_dir):
    known = repos(spark, sf_dir)
    at_head = files(spark, sf_dir).join(known.select(F.col("name").alias("repo"), F.col("indexed_commit").alias("commit"), F.lit("main").alias("branch")), "repo")
    found, _ = S.matching(at_head, "rev:HEAD Settle", repos=known)
    return found.select("doc_id", "repo")


@R.query(
    "focused_unit_search",
    sql=f"""WITH {_FILES_SQL} SELECT doc_id, path, CASE WHEN regexp_matches(path, '^docs/(kirhar|pargem)(/|$)') THEN 'primary' ELSE 'supporting' END AS unit_class
    FROM files WHERE regexp_matches(path, '^docs(/|$)') AND (regexp_matches(content, '(?i)atom') OR regexp_matches(p, '(?i)atom'))""",
)
def focused_unit_search(spark, sf_dir):
    unit = S.in_unit(files(spark, sf_dir), ["docs/kirhar", "docs/pargem"], ["docs"])
    return S.matching(unit, "atom")[0].select("doc_id", "path", "unit_class")


@R.query(
    "search_usage_event",
    sql=f"""WITH {_FILES_SQL}, hit AS (SELECT * FROM files WHERE contains(content, 'ArchiveQuota') OR contains(p, 'ArchiveQuota'))
    SELECT coalesce(array_to_string(list_sort(list(DISTINCT repo))[1:50], ','), '') AS repos, count(*) AS file_count FROM hit""",
)
def search_usage_event(spark, sf_dir):
    return S.usage_event(S.matching(X.narrowed(files(spark, sf_dir), published_index(spark, sf_dir), "doc_id", "ArchiveQuota"), "ArchiveQuota")[0]).select(F.array_join("repos", ",").alias("repos"), "file_count")


@R.query(
    "content_atoms",
    sql="""SELECT sha256(text) AS blob, count(*) AS placements, count(DISTINCT repo) AS repositories, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1""",
)
def content_atoms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.groupBy(F.sha2("text", 256).alias("blob")).agg(F.count("*").alias("placements"), F.countDistinct("repo").alias("repositories"), F.min("doc_id").alias("first_doc")).where("placements > 1")


@R.query(
    "search_trigram_index",
    sql=f"""WITH {_FILES_SQL}
    SELECT doc_id, repo, path, language, ({_hits("content", "settlement loop", "(?i)")} + regexp_matches(p, '(?i)settlement loop')::INT + {_hits("content", "Quota")} + contains(p, 'Quota')::INT)::BIGINT AS score FROM files
    WHERE (regexp_matches(content, '(?i)settlement loop') OR regexp_matches(p, '(?i)settlement loop')) AND (contains(content, 'Quota') OR contains(p, 'Quota')) {_TOP} LIMIT 50""",
)
def search_trigram_index(spark, sf_dir):
    """Several required terms through the published index."""
    return _search(spark, sf_dir, '"settlement loop" Quota').select(*_COLUMNS)
