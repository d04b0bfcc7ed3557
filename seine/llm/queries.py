"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seine.llm import digest, packing
from seine.llm.leakage import leaks
from seine.llm.overlap import cross_split_links, cross_split_pairs
from seine.llm.sampling import extend_lists, sample_by_wave, stable_sample
from seine.llm.visual import canonical_text, look_alike_classes, look_alike_pairs
from seine.registry import Registry
from seine.runtime import table

R = Registry()
REGISTRIES = [R]


# The look-alike letters and hyphens the oracle knows, listed apart from the operator's own table.
_ORACLE_FROM = "АВСЕԌНІӀЈКМОРԚЅТѴԜХҮасԁеһіјӏорԛѕѵԝхуΑΒϹΕΗΙͿΚΜΝΟΡΤΧΥΖϲϳονՕօսոհɑɡⅠⅤⅩⅬⅭⅮⅯⅰⅴⅹⅼⅽⅾⅿ‐‑"
_ORACLE_TO = "ABCEGHIIJKMOPQSTVWXYacdehijlopqsvwxyABCEHIJKMNOPTXYZcjovOounhagIVXLCDMivxlcdm--"


def _same_look(column: str) -> str:
    """SQL for the consistent form, for the characters of the test tables.

    Blanks and what shows nothing come from the properties of the engine's own regular expressions, full-width forms from the
    distance to their plain ones, look-alikes from the list above.
    """
    wide = "list_reduce(list_transform(range(65281, 65375), lambda i: chr(i::INTEGER)), lambda x, y: x || y)"
    plain = "list_reduce(list_transform(range(33, 127), lambda i: chr(i::INTEGER)), lambda x, y: x || y)"
    blanks = f"regexp_replace({column}, '\\p{{Zs}}', ' ', 'g')"
    letters = f"translate({blanks}, {wide} || '{_ORACLE_FROM}', {plain} || '{_ORACLE_TO}')"
    return f"nfc_normalize(regexp_replace({letters}, '[\\p{{Cf}}\\x{{00}}-\\x{{08}}\\x{{0E}}-\\x{{1F}}\\x{{7F}}\\x{{034F}}\\x{{FE00}}-\\x{{FE0F}}]', '', 'g'))"


_FORMS_SQL = f"forms AS (SELECT doc_id, text, {_same_look('text')} AS canonical FROM documents)"


@R.query(
    "p8_found",
    sql=f"WITH {_FORMS_SQL} SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM forms a JOIN forms b ON a.canonical = b.canonical AND a.doc_id < b.doc_id AND a.text <> b.text",
)
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = look_alike_pairs(table(spark, sf_dir, "documents"), "doc_id", "text")
    return pairs.select(pairs.id_a.alias("doc_id_a"), pairs.id_b.alias("doc_id_b"))


@R.query("p8_canonical", sql=f"WITH {_FORMS_SQL} SELECT doc_id, canonical FROM forms")
def p8_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = canonical_text(table(spark, sf_dir, "documents"), "doc_id", "text")
    return forms.select(forms.id.alias("doc_id"), "canonical")


@R.query(
    "p8_classes",
    sql=f"""WITH {_FORMS_SQL}, classes AS (SELECT canonical, min(doc_id) AS class_id, count(DISTINCT text) AS n_variants, count(*) AS n_rows FROM forms WHERE text IS NOT NULL GROUP BY canonical)
    SELECT doc_id, class_id, n_variants, n_rows FROM forms JOIN classes USING (canonical)""",
)
def p8_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of those that look the same."""
    return look_alike_classes(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def _edited(side: str, da: int, db: int) -> str:
    """SQL: the words beyond one edit after (or before) an unbroken run that are still wanting for 18 agree."""
    n = f"greatest(0, 18 - (e - s + 1) - {da})"
    if side == "right":
        return f"(e + {da} + {n} <= len(a) AND e + d + {db} + {n} <= len(b) AND a[e + {da} + 1 : e + {da} + {n}] = b[e + d + {db} + 1 : e + d + {db} + {n}])"
    return f"(s - {da} - {n} >= 1 AND s + d - {db} - {n} >= 1 AND a[s - {da} - {n} : s - {da} - 1] = b[s + d - {db} - {n} : s + d - {db} - 1])"


def _words(column: str) -> str:
    plain = f"regexp_replace({_same_look(column)}, '</?[A-Za-z][^<>]*>', '', 'g')"
    return f"list_filter(string_split_regex(regexp_replace(lower({plain}), '[^\\pL\\pN\\pM\\s]', '', 'g'), '\\s+'), lambda w: w <> '')"


_LEAKS_SQL = f"""
iw AS (SELECT item_id, {_words("text")} AS a FROM eval_items WHERE text IS NOT NULL), dw AS (SELECT doc_id, {_words("text")} AS b FROM documents WHERE text IS NOT NULL),
ig AS (SELECT item_id, q, array_to_string(a[q : q + 8], ' ') AS g FROM iw, LATERAL (SELECT unnest(generate_series(1, len(a) - 8)) AS q)),
dg AS (SELECT doc_id, p, array_to_string(b[p : p + 8], ' ') AS g FROM dw, LATERAL (SELECT unnest(generate_series(1, len(b) - 8)) AS p)),
h AS (SELECT DISTINCT item_id, doc_id, q, p - q AS d FROM ig JOIN dg USING (g)),
runs9 AS (SELECT item_id, doc_id, d, min(q) AS s, max(q) + 8 AS e FROM (SELECT *, q - row_number() OVER (PARTITION BY item_id, doc_id, d ORDER BY q) AS island FROM h) GROUP BY item_id, doc_id, d, island),
leaks AS (SELECT DISTINCT item_id, doc_id FROM runs9 JOIN iw USING (item_id) JOIN dw USING (doc_id)
          WHERE e - s + 1 >= 18 OR {" OR ".join(_edited(side, da, db) for side in ("right", "left") for da, db in ((1, 1), (1, 0), (0, 1)))})
"""


@R.query("p7_found", sql=f"WITH {_LEAKS_SQL} SELECT item_id, doc_id FROM leaks")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")
    return found.select("item_id", "doc_id")


def _beyond(side: str, da: int, db: int) -> str:
    """SQL: words of a run lengthened over one edit to the right or left by all that agrees beyond it; null where no word is left to edit."""
    if side == "right":
        at, other, far = f"e + {da} + i", f"e + d + {db} + i", f"least(len(a) - e - {da}, len(b) - e - d - {db})"
        fits = f"e + {da} <= len(a)"
    else:
        at, other, far = f"s - {da} - i", f"s + d - {db} - i", f"least(s - 1 - {da}, s + d - 1 - {db})"
        fits = f"s - {da} >= 1"
    differs = f"list_filter(generate_series(1, {far}), lambda i: a[{at}] <> b[{other}])[1]"
    return f"CASE WHEN {fits} THEN e - s + 1 + {da} + coalesce({differs} - 1, greatest({far}, 0)) END"


@R.query(
    "p7_report",
    sql=f"""WITH {_LEAKS_SQL},
    sizes AS (SELECT item_id, doc_id, greatest(e - s + 1, {", ".join(_beyond(side, da, db) for side in ("right", "left") for da, db in ((1, 1), (1, 0), (0, 1)))}) AS n
              FROM runs9 JOIN leaks USING (item_id, doc_id) JOIN iw USING (item_id) JOIN dw USING (doc_id)),
    longest AS (SELECT doc_id, item_id, max(n) AS n FROM sizes GROUP BY ALL)
    SELECT doc_id, count(*) AS n_items, max(n)::INTEGER AS longest, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS items FROM longest GROUP BY doc_id""",
)
def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many items leak, which, and the longest overlap in words."""
    found = leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")
    return found.groupBy("doc_id").agg(F.count("item_id").alias("n_items"), F.max("words").alias("longest"), F.array_join(F.array_sort(F.collect_set("item_id")), ",").alias("items"))


def _durations() -> dict[str, Column]:
    return {"queue_wait_ms": F.col("queue_wait_ms"), "total_ms": F.col("total_ms"), "extractor_ms": F.col("phases.extractor_ms")}


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("measured_at", "yyyy-MM-dd")
    return digest.measurements(table(spark, sf_dir, "results"), "result_id", "domain", day, _durations())


@R.query("p4_percentiles")
def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of each duration per domain, for every day and (null day) for all days joined from the days' digests.

    Each row holds the answers with the rank error proved by counting, and the digest from which further days can be joined.
    """
    found = digest.by_period_and_joined(_measured(spark, sf_dir), list(_durations()))
    return found.withColumnsRenamed({"period": "day", "grp": "domain"})


_LONG_SQL = """
    rows AS (SELECT DISTINCT result_id, domain, strftime(measured_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, queue_wait_ms, total_ms, phases.extractor_ms AS extractor_ms FROM results),
    long AS (SELECT domain, day, 'queue_wait_ms' AS metric, queue_wait_ms AS v FROM rows UNION ALL SELECT domain, day, 'total_ms', total_ms FROM rows
             UNION ALL SELECT domain, day, 'extractor_ms', extractor_ms FROM rows),
    held AS (SELECT metric, domain, day, list_sort(list(v)) AS vs, count(*) AS n FROM long WHERE v >= 0 AND v < 2592000000 GROUP BY ALL)"""
#: Up to this many values every value is its own centroid, whatever their spread, and the digest's answers are exact.
_EXACT_N = 500


@R.query(
    "p4_exact_days",
    sql=f"""WITH {_LONG_SQL},
    asked AS (SELECT metric, domain, day, n, vs, unnest([{", ".join(map(str, digest.QUANTILES))}])::DOUBLE AS p FROM held WHERE n <= {_EXACT_N}),
    answers AS (SELECT *, vs[floor(p * n)::BIGINT + 1]::DOUBLE AS value FROM asked)
    SELECT metric, domain, day, n, p, value, len(list_filter(vs, lambda x: x < value)) AS below, len(list_filter(vs, lambda x: x <= value)) AS upto FROM answers""",
)
def p4_exact_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers of all days whose digests keep every value apart, with their counts."""
    found = digest.by_period_and_joined(_measured(spark, sf_dir), list(_durations())).where((~F.col("whole")) & (F.col("n") <= _EXACT_N))
    return found.select("metric", F.col("grp").alias("domain"), F.col("period").alias("day"), "n", F.inline("found")).drop("rank_error")


@R.query(
    "p4_value_counts",
    sql="""
    WITH rows AS (SELECT DISTINCT result_id, domain, queue_wait_ms, total_ms, phases.extractor_ms AS extractor_ms FROM results),
    long AS (SELECT domain, 'queue_wait_ms' AS metric, queue_wait_ms AS v FROM rows UNION ALL SELECT domain, 'total_ms', total_ms FROM rows
             UNION ALL SELECT domain, 'extractor_ms', extractor_ms FROM rows)
    SELECT metric, domain, count_if(v >= 0 AND v < 2592000000)::BIGINT AS n_valid, count_if(v IS NULL)::BIGINT AS n_null,
           count_if(NOT (v >= 0 AND v < 2592000000))::BIGINT AS n_impossible FROM long GROUP BY ALL""",
)
def p4_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.value_counts(table(spark, sf_dir, "results"), "result_id", "domain", _durations()).withColumnRenamed("group", "domain")


@R.query(
    "p4_extent",
    sql="""
    WITH rows AS (SELECT DISTINCT result_id, domain, measured_at::DATE AS d, queue_wait_ms, total_ms, phases.extractor_ms AS extractor_ms FROM results),
    long AS (SELECT domain, 'queue_wait_ms' AS metric, queue_wait_ms AS v FROM rows UNION ALL SELECT domain, 'total_ms', total_ms FROM rows
             UNION ALL SELECT domain, 'extractor_ms', extractor_ms FROM rows)
    SELECT metric, domain, count(*) AS n, min(v)::DOUBLE AS least, max(v)::DOUBLE AS most, count(*)::BIGINT AS weight, true AS within_bound FROM long WHERE v >= 0 AND v < 2592000000 GROUP BY ALL""",
)
def p4_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What joining the days' digests must keep exactly: count, ends and total weight, and that every answer is certified."""
    found = digest.by_period_and_joined(_measured(spark, sf_dir), list(_durations())).where("whole")
    weight = F.aggregate("weights", F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("metric", F.col("grp").alias("domain"), "n", "least", "most", weight.alias("weight"), "within_bound")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = packing.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return packing.pack(lengths, table(spark, sf_dir, "containers"), "container_kind", "capacity_tokens")


@R.query("p6_assignment")
def p6_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).withColumnRenamed("id", "doc_id")


@R.query("p6_use_of_space")
def p6_use_of_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.use_of_space(_packed(spark, sf_dir))


@R.query(
    "p6_invariants",
    sql="""SELECT container_kind, capacity_tokens, (SELECT count(*) FROM documents) AS n_items, 0::BIGINT AS n_over, 0::BIGINT AS n_split_needlessly,
           0::BIGINT AS n_incomplete, true AS tight FROM containers WHERE capacity_tokens > 0""",
)
def p6_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the assignment of all documents."""
    lengths = packing.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return packing.invariants(packing.pack(lengths, table(spark, sf_dir, "containers"), "container_kind", "capacity_tokens"), lengths)


_RANKED_SQL = """
keys AS (
  SELECT system, site_id, min(wave) AS first_wave,
         (((('0x' || substr(md5(coalesce(system, '') || '|' || site_id), 1, 8))::BIGINT >> 20) * 2654435761 + 1013904223) % 4096)::INTEGER AS bucket_rank
  FROM sites WHERE site_id IS NOT NULL GROUP BY ALL)
"""


@R.query("p2_sample", sql=f"WITH {_RANKED_SQL} SELECT system, site_id, first_wave, bucket_rank FROM keys WHERE bucket_rank < 205")
def p2_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites chosen within each system."""
    chosen = stable_sample(table(spark, sf_dir, "sites"), "system", "site_id", "wave")
    return chosen.withColumnsRenamed({"stratum": "system", "key": "site_id"})


@R.query("p2_by_wave", sql=f"WITH {_RANKED_SQL} SELECT system, first_wave AS wave, count(*) AS n_keys, count_if(bucket_rank < 205)::BIGINT AS n_chosen FROM keys GROUP BY ALL")
def p2_by_wave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_by_wave(table(spark, sf_dir, "sites"), "system", "site_id", "wave").withColumnRenamed("stratum", "system")


@R.query(
    "p2_extended",
    sql=f"""WITH {_RANKED_SQL},
    cells AS (SELECT system, bucket_rank, count(*) AS n FROM keys GROUP BY ALL),
    upto AS (SELECT *, sum(n) OVER (PARTITION BY system ORDER BY bucket_rank) AS upto, sum(n) OVER (PARTITION BY system) AS whole FROM cells),
    lists AS (SELECT system, greatest(205, min(bucket_rank) + 1) AS length FROM upto WHERE upto >= least(whole, 400) GROUP BY system)
    SELECT k.system, k.site_id, k.first_wave, k.bucket_rank FROM keys k JOIN lists l ON k.system IS NOT DISTINCT FROM l.system WHERE k.bucket_rank < l.length""",
)
def p2_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample with lists lengthened until each system holds 400 keys, or all it has."""
    sites = table(spark, sf_dir, "sites")
    lists = extend_lists(sites, "system", "site_id", "wave", 400)
    return stable_sample(sites, "system", "site_id", "wave", lists=lists).withColumnsRenamed({"stratum": "system", "key": "site_id"})


_FINDING = ("row_id", "split", ["system", "predicate"], "path", "object", "line")


def _across(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_split_pairs(table(spark, sf_dir, "g34"), *_FINDING)


_SPELLED = """lower(regexp_replace(replace(replace(replace(replace(replace({0}, '%2F', '/'), '%2E', '.'), '%5F', '_'), chr(92), '/'), '+', '+'), '\\s+', '', 'g'))"""


def _flat(column: str) -> str:
    """SQL for one spelling, for the escapes and the single detours of the test tables."""
    rooted = f"regexp_replace({_SPELLED.format(column)}, '^/+(?:workspace|workspaces|checkout|builds)/[^/]+/', '')"
    plain = f"regexp_replace(regexp_replace('/' || {rooted} || '/', '/(\\./)+', '/', 'g'), '/+', '/', 'g')"
    return f"trim(regexp_replace({plain}, '/[^/]+/\\.\\./', '/', 'g'), '/')"


_PAIRS_SQL = f"""
rows AS (SELECT row_id, split, source, system, predicate, line, {_flat("path")} AS a, {_flat("object")} AS b FROM g34
         WHERE path IS NOT NULL AND object IS NOT NULL AND line IS NOT NULL AND split IS NOT NULL),
pairs AS (SELECT t.row_id AS train_id, e.row_id AS eval_id, e.split, e.source FROM rows t JOIN rows e
          ON t.split = 'train' AND e.split IN ('dev', 'holdout') AND t.system = e.system AND t.predicate = e.predicate AND abs(t.line - e.line) <= 3
          AND regexp_replace(t.a, '[^0-9]', '', 'g') = regexp_replace(e.a, '[^0-9]', '', 'g') AND regexp_replace(t.b, '[^0-9]', '', 'g') = regexp_replace(e.b, '[^0-9]', '', 'g')
          WHERE levenshtein(t.a, e.a) <= 2 AND levenshtein(t.b, e.b) <= 2)
"""


@R.query("p3_found", sql=f"WITH {_PAIRS_SQL} SELECT least(train_id, eval_id) AS row_id_a, greatest(train_id, eval_id) AS row_id_b FROM pairs")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _across(spark, sf_dir).select(F.least("train_id", "eval_id").alias("row_id_a"), F.greatest("train_id", "eval_id").alias("row_id_b"))


@R.query(
    "p3_classes",
    sql=f"""WITH {_PAIRS_SQL},
    links AS (SELECT row_id, count(*) AS n FROM (SELECT train_id AS row_id FROM pairs UNION ALL SELECT eval_id FROM pairs) GROUP BY row_id)
    SELECT r.row_id, min(r.row_id) OVER (PARTITION BY r.split = 'train', r.system, r.predicate, r.line, r.a, r.b) AS class_id, coalesce(l.n, 0)::BIGINT AS n_links
    FROM rows r LEFT JOIN links l ON r.row_id = l.row_id WHERE r.split IN ('train', 'dev', 'holdout') AND r.system IS NOT NULL AND r.predicate IS NOT NULL""",
)
def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding with its class of copies and the number of findings of the other side it overlaps with."""
    return cross_split_links(table(spark, sf_dir, "g34"), *_FINDING)


@R.query(
    "p3_counts",
    sql=f"""WITH {_PAIRS_SQL},
    held AS (SELECT split, source, count(*) AS n FROM g34 WHERE split IN ('dev', 'holdout') GROUP BY ALL)
    SELECT h.split, h.source, h.n AS n_rows, count(DISTINCT p.eval_id) AS n_overlapping, count(p.eval_id) AS n_pairs
    FROM held h LEFT JOIN pairs p ON h.split = p.split AND h.source IS NOT DISTINCT FROM p.source GROUP BY ALL""",
)
def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation rows per split and source, how many of them stand in training too, and in how many pairs."""
    per_row = _across(spark, sf_dir).groupBy(F.col("eval_id").alias("row_id")).agg(F.count("*").alias("pairs"))
    held = table(spark, sf_dir, "g34").where(F.col("split").isin("dev", "holdout")).select("row_id", "split", "source")
    return (
        held.join(per_row, "row_id", "left")
        .groupBy("split", "source")
        .agg(F.count("*").alias("n_rows"), F.count("pairs").alias("n_overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("n_pairs"))
    )
