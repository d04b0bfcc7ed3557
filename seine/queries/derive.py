"""Extraction, posting, navigation and compatibility queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from seine.operators import codenav as N
from seine.operators import contracts as K
from seine.operators import gosource as G
from seine.operators import postings as P
from seine.registry import Registry
from seine.runtime import table

R = Registry()


def _documents(spark, sf_dir, kind):
    return table(spark, sf_dir, "documents").where((F.col("kind") == kind) & F.col("text").isNotNull()).select("doc_id", "text")


# SQL patterns of the shapes the test tables hold: comments go, a field is a statement of its own
_FIELD_RE = r"(?:(?:repeated|optional|required)\s+)?(?:map\s*<[^>]*>|[A-Za-z_][\w.]*)\s+[A-Za-z_]\w*\s*=\s*\d+\s*;"
# a file is clean if nothing is left when its fields, blocks and statements are taken away
_CONTRACTS_SQL = rf"""
contracts AS (SELECT doc_id, regexp_replace(text, '//[^\n]*', '', 'g') AS t FROM documents WHERE kind = 'contract' AND text IS NOT NULL),
bare AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(t, '{_FIELD_RE}', '', 'g'), '(?:message|service)\s+\w+\s*\{{\s*\}}', '', 'g'), '(?:syntax\s*=\s*"[^"]*"|package\s+[\w.]+|import\s+"[^"]*")\s*;', '', 'g') AS left_over FROM contracts),
judged AS (SELECT doc_id, t, regexp_full_match(left_over, '\s*') AS clean FROM bare),
fields AS (SELECT doc_id, unnest(regexp_extract_all(t, '{_FIELD_RE}', 0)) AS f FROM judged WHERE clean)
"""


@R.query(
    "proto_messages_per_file",
    sql=f"""WITH {_CONTRACTS_SQL}, n AS (SELECT doc_id, count(*) AS fields FROM fields GROUP BY doc_id),
    m AS (SELECT doc_id, len(regexp_extract_all(t, '\\bmessage\\s+\\w+\\s*\\{{', 0)) AS messages, clean FROM judged)
    SELECT m.doc_id, clean, CASE WHEN clean THEN messages::BIGINT END AS messages, CASE WHEN clean THEN coalesce(fields, 0)::BIGINT END AS fields FROM m LEFT JOIN n ON m.doc_id = n.doc_id WHERE messages > 0 OR NOT clean""",
)
def proto_messages_per_file(spark, sf_dir):
    """Declared messages and fields per contract file, if all of it could be read: a letter of another script must give a gap."""
    facts = K.extract_facts(_documents(spark, sf_dir, "contract"), "doc_id", "text", "proto")
    per = facts.groupBy(F.col("key").alias("doc_id")).agg(
        (F.count_if(F.col("predicate") == "GAP") == 0).alias("clean"), F.count_if(F.col("predicate") == "DECLARES_MESSAGE").alias("messages"), F.count_if(F.col("predicate") == "DECLARES_FIELD").alias("fields")
    )
    return per.select("doc_id", "clean", *[F.when(F.col("clean"), F.col(c)).alias(c) for c in ("messages", "fields")])


@R.query(
    "proto_declared_fields",
    sql=rf"""WITH {_CONTRACTS_SQL}
    SELECT doc_id, regexp_extract(f, '(repeated|optional|required)\s', 1) AS label, regexp_extract(f, '([\w.]+|map\s*<[^>]*>)\s+\w+\s*=', 1) AS type, regexp_extract(f, '(\w+)\s*=', 1) AS name, regexp_extract(f, '=\s*(\d+)', 1)::INTEGER AS number
    FROM fields""",
)
def proto_declared_fields(spark, sf_dir):
    """Fields of the contract files that were read without a gap."""
    facts = K.extract_facts(_documents(spark, sf_dir, "contract"), "doc_id", "text", "proto")
    whole = facts.where("predicate = 'DECLARES_FIELD'").join(facts.where("predicate = 'GAP'").select("key").distinct(), "key", "left_anti")
    return whole.select(F.col("key").alias("doc_id"), "label", "type", "name", "number")


@R.query(
    "go_functions_and_calls",
    sql=r"""WITH sources AS (SELECT doc_id, regexp_replace(text, '//[^\n]*', '', 'g') AS t FROM documents WHERE kind = 'source_file' AND text IS NOT NULL),
    sites AS (SELECT doc_id, 'function' AS kind, regexp_extract(x, '([\pL\pN_]+)\($', 1) AS method FROM (SELECT doc_id, unnest(regexp_extract_all(t, '(?m)^func\s*(?:\([^)]*\)\s*)?[\pL\pN_]+\(', 0)) AS x FROM sources)
      UNION ALL SELECT doc_id, 'call', regexp_extract(x, '([\pL\pN_]+)\($', 1) FROM (SELECT doc_id, unnest(regexp_extract_all(t, '(?:[\pL\pN_]+\.)+[A-Z][\pL\pN_]*\(', 0)) AS x FROM sources))
    SELECT kind, method, count(*) AS n, count(DISTINCT doc_id) AS files FROM sites GROUP BY ALL""",
)
def go_functions_and_calls(spark, sf_dir):
    """Function declarations and selector calls of source files."""
    sites = G.scan_calls(_documents(spark, sf_dir, "source_file"), "doc_id", "text")
    return sites.where("kind IN ('function', 'call')").groupBy("kind", "method").agg(F.count("*").alias("n"), F.countDistinct("key").alias("files"))


@R.query(
    "go_observation_reuse",
    sql="""WITH d AS (SELECT sha256(text) AS h, coalesce(updated_at < '2025-09-01'::TIMESTAMPTZ, false) AS known FROM documents WHERE kind = 'source_file' AND text IS NOT NULL)
    SELECT count(DISTINCT h) AS n FROM d WHERE NOT known AND h NOT IN (SELECT h FROM d WHERE known)""",
)
def go_observation_reuse(spark, sf_dir):
    """Distinct contents still to be parsed when those of a previous generation are known."""
    d = table(spark, sf_dir, "documents").where("kind = 'source_file' AND text IS NOT NULL")
    known = F.coalesce(F.col("updated_at") < F.lit("2025-09-01 00:00:00").cast("timestamp"), F.lit(False))
    contents = d.select(F.sha2("text", 256).alias("digest"), known.alias("known"))
    fresh, _ = K.parse_with_reuse(contents.where("NOT known"), contents.where("known"), "digest")
    return fresh.agg(F.countDistinct("digest").alias("n"))


@R.query(
    "kafka_postings",
    sql="""SELECT row_id::VARCHAR AS site_id, CASE WHEN object IS NOT NULL AND regexp_full_match(object, '[A-Za-z0-9._-]{1,249}') AND object NOT IN ('.', '..') THEN 'literal' ELSE 'unresolved' END AS class,
      CASE WHEN object IS NULL THEN 'non-literal-expr' WHEN regexp_full_match(object, '[A-Za-z0-9._-]{1,249}') AND object NOT IN ('.', '..') THEN NULL ELSE 'invalid-topic-literal' END AS reason FROM g34""",
)
def kafka_postings(spark, sf_dir):
    g = table(spark, sf_dir, "g34").select(F.col("row_id").cast("string").alias("site_id"), F.lit("producer").alias("plane"), F.col("object").alias("topic"), F.lit(None).cast("string").alias("reason"))
    return P.kafka_postings(g).select("site_id", "class", "reason")


@R.query(
    "topic_evidence_groups",
    sql="""SELECT system AS plane, predicate AS topic, CASE WHEN bool_or(tier = 'exact') THEN 'exact' ELSE 'derived' END AS tier, '[' || string_agg('"' || source || '"', ',' ORDER BY source) || ']' AS libraries, sum(n)::BIGINT AS sites
    FROM (SELECT system, predicate, source, min(CASE tier WHEN 'exact' THEN 'exact' ELSE 'x' END) AS tier, count(*) AS n FROM g34 WHERE source IS NOT NULL GROUP BY ALL) GROUP BY ALL""",
)
def topic_evidence_groups(spark, sf_dir):
    g = table(spark, sf_dir, "g34").where("source IS NOT NULL").select(F.col("system").alias("plane"), F.col("predicate").alias("topic"), "tier", F.col("source").alias("library"), F.lit("x").alias("shape"))
    return P.topic_evidence(g).select("plane", "topic", "tier", "libraries", "sites")


@R.query(
    "topic_census",
    sql="""SELECT p.plane, c.class, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(['harborlight', 'oakum', 'nowhere']) AS plane) p CROSS JOIN (SELECT unnest(['exact', 'derived', 'heuristic']) AS class) c
    LEFT JOIN (SELECT system, tier, count(*) AS n FROM g34 GROUP BY ALL) g ON g.system = p.plane AND g.tier = c.class""",
)
def topic_census(spark, sf_dir):
    g = table(spark, sf_dir, "g34").select(F.col("system").alias("plane"), F.col("tier").alias("class"), F.array("row_id").alias("supporting"))
    return P.topic_census(g, ["harborlight", "oakum", "nowhere"], ["exact", "derived", "heuristic"])


@R.query("resolver_conflicts", sql="SELECT object AS symbol, array_to_string(list_sort(list(DISTINCT path)), '|') AS candidates FROM g34 WHERE object IS NOT NULL AND path IS NOT NULL GROUP BY object HAVING count(DISTINCT path) >= 2")
def resolver_conflicts(spark, sf_dir):
    g = table(spark, sf_dir, "g34").where("object IS NOT NULL AND path IS NOT NULL").select(F.col("object").alias("symbol"), "path")
    return P.resolver_conflicts(g, ["symbol"], "path").select("symbol", F.array_join("candidates", "|").alias("candidates"))


_CALLS_SQL = """
c AS (SELECT row_id AS call_id, regexp_extract(object, '[^/.]+$') AS selector, CASE WHEN tier = 'exact' THEN 'resolved' WHEN row_id % 5 = 0 THEN 'dynamic' ELSE 'resolved' END AS receiver, system, row_id % 2 = 0 AS exact FROM g34 WHERE gate = 3 AND object IS NOT NULL),
r AS (SELECT DISTINCT system AS namespace, regexp_extract(object, '[^/.]+$') AS method, object AS operation, CASE WHEN length(object) % 11 = 0 THEN 'ambiguous' ELSE 'resolved' END AS state FROM g34 WHERE gate = 3 AND object IS NOT NULL AND split = 'train'),
j AS (SELECT c.call_id, c.receiver, c.exact, r.operation, r.state FROM c JOIN r ON c.system = r.namespace AND c.selector = r.method),
g AS (SELECT call_id, min(receiver) AS receiver, bool_or(exact) AS exact, count_if(state = 'resolved') AS res, count_if(state = 'ambiguous') AS amb, count(DISTINCT operation) FILTER (state = 'resolved') AS ops, min(operation) FILTER (state = 'resolved') AS operation FROM j GROUP BY call_id),
p AS (SELECT *, CASE WHEN receiver = 'dynamic' THEN 'dynamic_receiver' WHEN amb > 0 THEN 'resolver_ambiguous' WHEN res <> 1 AND ops > 1 THEN 'ambiguous_method_candidates' WHEN res <> 1 THEN 'ambiguous_receiver_provenance' WHEN NOT exact THEN 'name_match_only' END AS reason FROM g)
"""


@R.query("rpc_call_projection", sql=f"WITH {_CALLS_SQL} SELECT call_id, CASE WHEN reason IS NULL THEN 'resolved' WHEN reason = 'name_match_only' THEN 'name_match' ELSE 'unresolved' END AS class, reason, CASE WHEN reason IS NULL THEN operation END AS operation FROM p")
def rpc_call_projection(spark, sf_dir):
    g = table(spark, sf_dir, "g34").where("gate = 3 AND object IS NOT NULL")
    method = F.regexp_extract("object", r"[^/.]+$", 0)
    receiver = F.when(F.col("tier") == "exact", "resolved").when(F.col("row_id") % 5 == 0, "dynamic").otherwise("resolved")
    calls = g.select(F.col("row_id").alias("call_id"), method.alias("selector"), receiver.alias("receiver"), F.array("system").alias("namespaces"), F.when(F.col("row_id") % 2 == 0, F.array("system")).otherwise(F.array().cast("array<string>")).alias("bound"))
    records = g.where("split = 'train'").select(F.col("system").alias("namespace"), method.alias("method"), F.col("object").alias("operation"), F.when(F.char_length("object") % 11 == 0, "ambiguous").otherwise("resolved").alias("state")).distinct()
    return P.project_calls(calls, records)


@R.query(
    "call_class_counts",
    sql="""WITH s AS (SELECT DISTINCT regexp_extract(object, '[^/.]+$') AS method, system FROM g34 WHERE object IS NOT NULL AND split = 'train'), i AS (SELECT method, count(DISTINCT system) AS n FROM s GROUP BY 1)
    SELECT CASE WHEN n = 1 THEN 'resolved' ELSE 'abstained' END AS class, count(*) AS calls FROM (SELECT regexp_extract(object, '[^/.]+$') AS method FROM g34 WHERE object IS NOT NULL AND split = 'dev') c JOIN i USING (method) GROUP BY 1""",
)
def call_class_counts(spark, sf_dir):
    g = table(spark, sf_dir, "g34").where("object IS NOT NULL").withColumn("method", F.regexp_extract("object", r"[^/.]+$", 0))
    found = P.resolve_exactly_one(g.where("split = 'dev'").select("method"), g.where("split = 'train'").select("method", "system"), ["method"], "system")
    return found.groupBy("class").agg(F.count("*").alias("calls"))


@R.query("anchor_collapse", sql="SELECT object AS symbol, min(path) AS declaration, CASE WHEN count(DISTINCT tier) = 1 THEN min(tier) END AS lineage FROM g34 WHERE object IS NOT NULL AND path IS NOT NULL GROUP BY object HAVING count(DISTINCT path) = 1")
def anchor_collapse(spark, sf_dir):
    g = table(spark, sf_dir, "g34").where("object IS NOT NULL AND path IS NOT NULL").select(F.col("object").alias("symbol"), F.col("path").alias("declaration"), F.col("tier").alias("lineage"))
    return P.collapse_anchors(g)


# code navigation: findings are occurrences, objects the symbols


def _occurrences(spark, sf_dir):
    g = table(spark, sf_dir, "g34").where("path IS NOT NULL AND line IS NOT NULL AND object IS NOT NULL")
    return g.select(
        F.col("object").alias("symbol"), "path", F.col("line").alias("start_line"), F.lit(1).alias("start_col"), F.col("line").alias("end_line"), F.lit(20).alias("end_col"),
        F.when(F.col("tier") == "exact", 1).otherwise(8).alias("roles"), F.col("detail").alias("override_documentation"),
    )


def _relations(spark, sf_dir):
    """A method is related to its service."""
    g = table(spark, sf_dir, "g34").where("object IS NOT NULL")
    return g.where("object LIKE '/%/%'").select(F.col("object").alias("symbol"), F.expr("substring_index(substring(object, 2), '/', 1)").alias("related"), F.lit(True).alias("is_reference"), F.lit(True).alias("is_definition")).distinct()


def _first_symbol(spark, sf_dir):
    return table(spark, sf_dir, "g34").where("object LIKE '/%/%'").agg(F.min("object").alias("symbol"))


_SYMBOL_SQL = """sym AS (SELECT min(object) AS s FROM g34 WHERE object LIKE '/%/%'), rel AS (SELECT DISTINCT object AS symbol, split_part(object[2:], '/', 1) AS related FROM g34 WHERE object LIKE '/%/%')"""


@R.query(
    "symbol_references",
    sql=f"""WITH {_SYMBOL_SQL}, want AS (SELECT s AS symbol FROM sym UNION SELECT related FROM rel, sym WHERE rel.symbol = sym.s UNION SELECT rel.symbol FROM rel, sym WHERE rel.related = sym.s)
    SELECT DISTINCT path, line AS start_line FROM g34 WHERE path IS NOT NULL AND line IS NOT NULL AND object IN (SELECT symbol FROM want) ORDER BY path, start_line LIMIT 500""",
)
def symbol_references(spark, sf_dir):
    return N.find_references(_first_symbol(spark, sf_dir), _occurrences(spark, sf_dir), _relations(spark, sf_dir)).select("path", "start_line")


@R.query(
    "symbol_definition",
    sql=f"""WITH {_SYMBOL_SQL}, want AS (SELECT s AS symbol FROM sym UNION SELECT related FROM rel, sym WHERE rel.symbol = sym.s) SELECT path, line AS start_line FROM g34 WHERE tier = 'exact' AND path IS NOT NULL AND line IS NOT NULL AND object IN (SELECT symbol FROM want) ORDER BY path, line LIMIT 1""",
)
def symbol_definition(spark, sf_dir):
    return N.definitions(_first_symbol(spark, sf_dir), _occurrences(spark, sf_dir), _relations(spark, sf_dir)).select("path", "start_line")


@R.query("symbol_hover", sql="SELECT object AS symbol, coalesce(min(detail) FILTER (path IS NOT NULL AND line IS NOT NULL), 'symbol of ' || min(system)) AS documentation FROM g34 WHERE object IS NOT NULL GROUP BY object")
def symbol_hover(spark, sf_dir):
    g = table(spark, sf_dir, "g34").where("object IS NOT NULL").withColumnRenamed("object", "symbol")
    information = g.groupBy("symbol").agg(F.concat(F.lit("symbol of "), F.min("system")).alias("documentation"))
    return N.hover(g.select("symbol").distinct(), information, _occurrences(spark, sf_dir))


_TREE_SQL = "e AS (SELECT DISTINCT regexp_replace(path, '/[^/]+$', '') AS parent, path AS child FROM documents WHERE contains(path, '/') UNION SELECT DISTINCT regexp_replace(regexp_replace(path, '/[^/]+$', ''), '/[^/]+$', ''), regexp_replace(path, '/[^/]+$', '') FROM documents WHERE path LIKE '%/%/%')"


@R.query(
    "shape_expand",
    sql=f"""WITH RECURSIVE {_TREE_SQL}, x AS (SELECT 'docs' AS node, 0 AS depth UNION ALL SELECT e.child, x.depth + 1 FROM x JOIN e ON e.parent = x.node WHERE x.depth < 6) SELECT depth, count(*) AS nodes FROM x GROUP BY depth""",
)
def shape_expand(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    up = lambda c: F.regexp_replace(c, r"/[^/]+$", "")
    files = d.where(F.col("path").contains("/")).select(up(F.col("path")).alias("parent"), F.col("path").alias("child"))
    folders = d.where(F.col("path").like("%/%/%")).select(up(up(F.col("path"))).alias("parent"), up(F.col("path")).alias("child"))
    edges = files.unionByName(folders).distinct()
    roots = spark.range(1).select(F.lit("docs").alias("node"))
    return N.expand(edges, roots).groupBy("depth").agg(F.count("*").alias("nodes"))


@R.query(
    "alias_chain",
    sql="""WITH RECURSIVE a AS (SELECT name AS alias, name || '/next' AS target FROM repos UNION ALL SELECT name || '/next', CASE WHEN is_fork THEN name ELSE name || '/end' END FROM repos),
    x AS (SELECT name AS root, name AS node, 0 AS d FROM repos UNION ALL SELECT x.root, a.target, d + 1 FROM x JOIN a ON a.alias = x.node WHERE d < 2)
    SELECT root AS name, CASE WHEN node = root THEN NULL ELSE node END AS target, CASE WHEN node = root THEN 'cycle' ELSE 'resolved' END AS state FROM x WHERE d = 2""",
)
def alias_chain(spark, sf_dir):
    r = table(spark, sf_dir, "repos")
    a = r.select(F.col("name").alias("alias"), F.concat("name", F.lit("/next")).alias("target")).unionByName(r.select(F.concat("name", F.lit("/next")).alias("alias"), F.when(F.col("is_fork"), F.col("name")).otherwise(F.concat("name", F.lit("/end"))).alias("target")))
    return N.resolve_aliases(a, r.select("name"))


# compatibility: parts are messages, their retail data two versions of a contract

_FIELDS_SQL = """
b AS (SELECT p_brand AS message, p_size AS number, min(p_name) AS name, min(p_type) AS type FROM part WHERE p_retailprice < 1500 GROUP BY ALL),
a AS (SELECT p_brand AS message, p_size AS number, min(p_name) AS name, min(p_type) AS type FROM part WHERE p_retailprice > 1000 AND p_brand <> 'Brand#11' GROUP BY ALL),
j AS (SELECT coalesce(b.message, a.message) AS message, coalesce(b.number, a.number) AS number, b.name AS bn, a.name AS an, b.type AS bt, a.type AS at_, coalesce(b.message, a.message) NOT IN (SELECT message FROM a) AS gone FROM b FULL JOIN a ON a.message = b.message AND a.number = b.number),
v AS (SELECT message, number, 'MESSAGE_REMOVED' AS rule, bn AS detail FROM j WHERE an IS NULL AND gone UNION ALL SELECT message, number, 'FIELD_REMOVED', bn FROM j WHERE an IS NULL AND NOT gone
      UNION ALL SELECT message, number, 'FIELD_TYPE_CHANGED', bt || '->' || at_ FROM j WHERE bt <> at_ UNION ALL SELECT message, number, 'FIELD_NAME_CHANGED', bn || '->' || an FROM j WHERE bn <> an)
"""


def _versions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    shape = lambda d: d.groupBy(F.col("p_brand").alias("message"), F.col("p_size").alias("number")).agg(F.min("p_name").alias("name"), F.min("p_type").alias("type")).withColumn("label", F.lit(""))
    return shape(p.where("p_retailprice < 1500")), shape(p.where("p_retailprice > 1000 AND p_brand <> 'Brand#11'"))


@R.query("compat_violations", sql=f"WITH {_FIELDS_SQL} SELECT message, number, rule, detail FROM v")
def compat_violations(spark, sf_dir):
    return K.violations(*_versions(spark, sf_dir))


@R.query("compat_affected_fields", sql=f"WITH {_FIELDS_SQL} SELECT DISTINCT message, number FROM v")
def compat_affected_fields(spark, sf_dir):
    return K.affected_fields(K.violations(*_versions(spark, sf_dir)))


@R.query(
    "compat_field_spans",
    sql="""WITH s AS (SELECT DISTINCT path, line AS start_line, line + 5 AS end_line, object AS field_id FROM g34 WHERE split = 'train' AND path IS NOT NULL AND line IS NOT NULL AND object IS NOT NULL)
    SELECT g.row_id, s.field_id FROM g34 g JOIN s ON g.path = s.path AND g.line >= s.start_line AND g.line < s.end_line WHERE g.split = 'dev'""",
)
def compat_field_spans(spark, sf_dir):
    g = table(spark, sf_dir, "g34")
    spans = g.where("split = 'train' AND path IS NOT NULL AND line IS NOT NULL AND object IS NOT NULL").select("path", F.col("line").alias("start_line"), (F.col("line") + 5).alias("end_line"), F.col("object").alias("field_id")).distinct()
    return K.match_declarations(g.where("split = 'dev'").select("row_id", "path", "line"), spans).select("row_id", "field_id")


@R.query(
    "consumer_fact_scan",
    sql="""WITH d AS (SELECT doc_id FROM documents),
    stubs AS (SELECT DISTINCT 'M' || doc_id % 7 AS method, 'A' AS service FROM d WHERE doc_id % 10 = 0 UNION SELECT DISTINCT 'M' || doc_id % 7, 'B' FROM d WHERE doc_id % 30 = 0 AND doc_id % 7 < 3),
    n AS (SELECT method, count(*) AS n, min('/svc.' || service || '/' || method) AS operation FROM stubs GROUP BY method)
    SELECT CASE WHEN n = 1 THEN 'CALLS_OPERATION' ELSE 'UNRESOLVED_CALL' END AS predicate, n.method, CASE WHEN n = 1 THEN operation END AS operation, 'Run' AS container, 'c.client' AS receiver, count(*) AS calls
    FROM d JOIN n ON n.method = 'M' || d.doc_id % 9 GROUP BY ALL""",
)
def consumer_fact_scan(spark, sf_dir):
    """Calls of one generated source file per document, met with the stubs that some of the files declare."""
    n = F.col("doc_id")
    method = F.concat(F.lit("M"), (n % 7).cast("string"))

    def stub(service: str):
        return F.concat(F.lit("func (x *stub) "), method, F.lit('() {\n\tx.cc.Invoke(ctx, "/svc.' + service + "/"), method, F.lit('", in)\n}\n'))

    text = F.concat(
        F.lit("package p\n// "), n.cast("string"), F.lit("\n"), F.when(n % 10 == 0, stub("A")).otherwise(""), F.when((n % 30 == 0) & (n % 7 < 3), stub("B")).otherwise(""),
        F.lit("func Run() {\n\tc.client.M"), (n % 9).cast("string"), F.lit("(ctx)\n}\n"),
    )
    sites = G.scan_calls(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")), "doc_id", "text")
    facts = G.consumer_facts(sites.where("kind = 'stub' OR receiver = 'c.client'"))
    return facts.groupBy("predicate", "method", "operation", "container", "receiver").agg(F.count("*").alias("calls"))


@R.query(
    "kafka_site_scan",
    sql="""WITH d AS (SELECT doc_id, replace(repo, '/', '.') AS topic FROM documents WHERE repo IS NOT NULL),
    s AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'producer' ELSE 'consumer' END AS plane, CASE WHEN doc_id % 3 = 0 THEN topic END AS topic, CASE doc_id % 3 WHEN 1 THEN 'selector-expr' WHEN 2 THEN 'unresolved-ident' END AS reason FROM d)
    SELECT plane, topic, reason, count(*) AS n, CASE WHEN topic IS NULL THEN 'unresolved' ELSE 'derived' END AS tier FROM s GROUP BY ALL""",
)
def kafka_site_scan(spark, sf_dir):
    """Topic sites of one generated source file per document: a literal, a selector or an unknown name as topic."""
    n, topic = F.col("doc_id"), F.regexp_replace("repo", "/", ".")
    expr = F.when(n % 3 == 0, F.concat(F.lit('"'), topic, F.lit('"'))).when(n % 3 == 1, "cfg.Topic").otherwise("topicName")
    kind = F.when(n % 2 == 0, "Writer").otherwise("ReaderConfig")
    text = F.concat(F.lit('package p\nimport kf "github.com/segmentio/kafka-go"\nfunc f() { // '), n.cast("string"), F.lit("\n\tx := kf."), kind, F.lit("{Topic: "), expr, F.lit("}\n}\n"))
    files = table(spark, sf_dir, "documents").where("repo IS NOT NULL").select("doc_id", text.alias("text"))
    return G.scan_kafka(files, "doc_id", "text").groupBy("plane", "topic", "reason", "tier").agg(F.count("*").alias("n"))
