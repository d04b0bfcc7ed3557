"""The public verbs. A :class:`Snapshot` holds the tables of one generation, already cut to what the caller may see."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seine.functions.scalars import valid_topic
from seine.operators import analytics, change, codenav, contracts, coverage, evidence, paging, services
from seine.operators import callers as C
from seine.plans import index as X
from seine.plans import search as S
from seine.sources import files as sources
from seine.vocab import CALLER_PAGE_DEFAULT, CALLER_PAGE_MOST, CENSUS_ASSERTIONS_MOST, DOMAINS, EVIDENCE_PAGE_MOST, REFERENCES_MOST


class InvalidRequest(ValueError):
    """An argument breaks a rule of the verb."""


@dataclass
class Snapshot:
    """Tables by name; ``identity`` limits every verb to the repositories it may see (null: all).

    Where the generation has a trigram index (``index`` with the files' ``key``), searches read only the files that can match.
    """

    tables: dict[str, DataFrame]
    identity: str | None = None
    contexts: dict[str, list[str]] = field(default_factory=dict)
    index: DataFrame | None = None
    key: str = "doc_id"

    def visible_repos(self) -> DataFrame:
        """Repositories the identity may see; the first operator of every verb."""
        repos = self.tables["repos"]
        if self.identity is None:
            return repos
        granted = self.tables["permissions"].where(F.lower(F.trim("identity")) == self.identity.strip().lower()).select(F.col("repo").alias("name")).distinct()
        return repos.join(granted, "name", "left_semi")

    def table(self, name: str) -> DataFrame:
        rows = self.tables[name]
        if self.identity is None or "repo" not in rows.columns:
            return rows
        return rows.join(self.visible_repos().select(F.col("name").alias("repo")), "repo", "left_semi")

    # search

    def search(self, q: str, max_matches: int | None = None, context_lines: int = 0, service_key: str | None = None) -> DataFrame:
        scope = {"repos": self.visible_repos(), "contexts": self.contexts}
        if service_key is not None:
            scope |= {"memberships": self.table("memberships"), "service_key": service_key}
        files = self.table("files")
        if self.index is not None:
            files = X.narrowed(files, self.index, self.key, q)
        return S.chunks(S.search(files, q, max_matches, **scope), S.parse(q), context_lines)

    # evidence

    def published_assertions(self) -> DataFrame:
        return evidence.visible(self.table("assertions"), self.table("runs"))

    def _proof(self, rows: DataFrame) -> DataFrame:
        """Assertion rows with their impact class and placements; a row without a placement keeps nulls."""
        spread = rows.select("assertion_id", "run_id", "repo", "domain", "predicate", "subject", "object", "lineage", "tier", F.explode_outer("supporting").alias("atom_id"))
        placed = spread.join(self.table("occurrences").select("run_id", "atom_id", "path", "start_line", "end_line"), ["run_id", "atom_id"], "left")
        return placed.withColumn("class", evidence.assertion_kind(F.col("predicate"), F.col("tier"), F.col("domain"), F.col("lineage"))).dropDuplicates(["assertion_id", "atom_id", "path", "start_line"])

    def find_operation_consumers(self, operation: str) -> DataFrame:
        if not operation.startswith("/") or operation.count("/") != 2 or operation.endswith("/"):
            raise InvalidRequest("an operation is written /service/method")
        domains = ("grpc-consumer", "grpc-caller", "thrift-consumer", "thrift-caller")
        return self._proof(self.published_assertions().where(F.col("domain").isin(*domains) & (F.col("object") == operation)))

    def find_field_references(self, lineage: str, message: str, number: int) -> DataFrame:
        domains = ("scip-proto-field", "scip-thrift-field")
        return self._proof(self.published_assertions().where(F.col("domain").isin(*domains) & (F.col("lineage") == lineage) & (F.col("object") == f"{message}#{number}")))

    def find_topic_usage(self, topic: str) -> DataFrame:
        """Producers and consumers of a topic."""
        rows = self.published_assertions().where(F.col("domain").isin("kafka-producer", "kafka-consumer") & (F.col("object") == topic))
        return self._proof(rows.where(valid_topic(F.col("object"))))

    def topic_census(self, classes: list[str]) -> DataFrame:
        """Unresolved sites per plane and class, every cell present, flagged where the scan bound was met."""
        rows = self.published_assertions().where(F.col("domain").isin("kafka-producer", "kafka-consumer") & F.col("predicate").startswith("UNRESOLVED_"))
        cells = coverage.densified_counts(rows.withColumn("class", F.col("object")), {"domain": ["kafka-producer", "kafka-consumer"], "class": classes}, F.sum(F.size("supporting")))
        seen = rows.groupBy("domain").agg((F.count("*") > CENSUS_ASSERTIONS_MOST).alias("_over"))
        return cells.join(seen, "domain", "left").select("domain", "class", "n", F.coalesce("_over", F.lit(False)).alias("over_bound"))

    def coverage(self, domains: list[str] | None = None) -> DataFrame:
        wanted = sorted(set(domains or DOMAINS))
        unknown = set(wanted) - set(DOMAINS)
        if unknown:
            raise InvalidRequest(f"unknown domain {sorted(unknown)[0]}")
        repos = self.visible_repos().select(F.col("name").alias("repo"), "indexed_commit")
        return coverage.certificate(repos, wanted, self.table("runs"))

    def _report(self, rows: DataFrame, domains: list[str]) -> dict[str, DataFrame]:
        parts = {name: rows.where(F.col("class") == kind) for name, kind in (("resolved", "resolved"), ("matching", "matching"), ("abstentions", "abstention"))}
        return {**parts, "coverage": self.coverage(domains)}

    def impact_report(self, operation: str) -> dict[str, DataFrame]:
        """Resolved, matching and abstained rows, and the coverage they rest on."""
        return self._report(self.find_operation_consumers(operation), ["grpc-consumer", "grpc-caller", "thrift-consumer", "thrift-caller"])

    def evidence_page(self, limit: int = 50, cursor: list | None = None, **filters) -> DataFrame:
        """Assertions of published runs in keyset order, with ``has_more``; ``filters`` as in ``evidence.list_assertions``."""
        k = min(max(limit, 1), EVIDENCE_PAGE_MOST)
        rows = evidence.list_assertions(self.published_assertions(), limit=k, cursor=cursor, **filters)
        order = [c for c in evidence.PAGE_KEYS if c in rows.columns]
        return paging.page_with_more(rows, order, k)

    def check_compatibility(self, before: DataFrame, after: DataFrame, reader: str = "proto") -> DataFrame:
        """Violations between two sets of .proto or .thrift files (path, content). Files with gaps on either side are listed as ``UNREADABLE``."""
        if reader not in ("proto", "thrift"):
            raise InvalidRequest("contracts are read as proto or thrift")

        def facts(files: DataFrame) -> DataFrame:
            return contracts.extract_facts(files, "path", "content", reader)

        def fields(found: DataFrame) -> DataFrame:
            return found.where("predicate = 'DECLARES_FIELD'").select(F.col("subject").alias("message"), "number", "name", "type", "label").distinct()

        old, new = facts(before), facts(after)
        gaps = old.unionByName(new).where("predicate = 'GAP'").select(F.col("subject").alias("message"), F.lit(None).cast("int").alias("number"), F.lit("UNREADABLE").alias("rule"), F.concat_ws(" ", "key", "type").alias("detail")).distinct()
        return contracts.violations(fields(old), fields(new)).unionByName(gaps).orderBy("message", "number", "rule")

    def field_impact_report(self, lineage: str, message: str, number: int) -> dict[str, DataFrame]:
        """As :meth:`impact_report`, for the references to one field."""
        return self._report(self.find_field_references(lineage, message, number), ["scip-proto-field", "scip-thrift-field"])

    def change_impact_report(self, before: DataFrame, after: DataFrame, lineage: str, reader: str = "proto") -> dict[str, DataFrame]:
        """The violations of a change and, joined by field, all references to the fields it affects."""
        found = self.check_compatibility(before, after, reader)
        affected = contracts.affected_fields(found.where("number IS NOT NULL")).select(F.concat("message", F.lit("#"), F.col("number").cast("string")).alias("object"))
        domains = ["scip-proto-field", "scip-thrift-field"]
        rows = self.published_assertions().where(F.col("domain").isin(*domains) & (F.col("lineage") == lineage)).join(affected, "object", "left_semi")
        return {"violations": found, **self._report(self._proof(rows), domains)}

    def stored_report(self, report_id: str) -> DataFrame:
        """Rows of a report kept under its id; empty if it is not there or names a repository that may not be seen."""
        rows = self.tables["reports"].where(F.col("report_id") == report_id)
        hidden = rows.where(F.col("repo").isNotNull()).join(self.visible_repos().select(F.col("name").alias("repo")), "repo", "left_anti")
        return rows.join(hidden.select("report_id").distinct(), "report_id", "left_anti")

    def shape(self, message: str) -> DataFrame:
        """Fields of a message and of the messages they hold, with every bound visible."""
        declared = self.published_assertions().where("predicate = 'DECLARES_FIELD'").select(F.col("subject").alias("parent"), F.col("object").alias("child"))
        roots = self.visible_repos().sparkSession.range(1).select(F.lit(message).alias("node"))
        return codenav.shape(declared, roots)

    # catalog, callers, relationships

    def atlas(self, limit: int = 50, scan_most: int = 50_000, after: tuple | None = None) -> DataFrame:
        declared = self.published_assertions().where("predicate = 'DECLARES_OPERATION'")
        rows = declared.select(C.protocol_of(F.col("domain")).alias("protocol"), "repo", F.col("subject").alias("service"), F.col("object").alias("operation")).where("protocol IS NOT NULL").distinct()
        return C.catalog_page(rows, limit, scan_most, after)

    def operation(self, operation: str, lineage: str) -> DataFrame:
        service = operation.strip("/").partition("/")[0]
        return C.operation_relationships(operation, service, lineage, self.published_assertions())

    def callers(self, operation: str, limit: int | None = None, offset: int = 0, **filters) -> DataFrame:
        rows = self.find_operation_consumers(operation).where("path IS NOT NULL").withColumnRenamed("assertion_id", "caller_id")
        k = CALLER_PAGE_DEFAULT if not limit or limit <= 0 else min(limit, CALLER_PAGE_MOST)
        return paging.offset_page(C.filter_callers(rows, **filters), C.caller_order(), offset, k)

    def caller_citation(self, caller_id: str) -> DataFrame:
        """The lines one caller row stands on, in the commit its run analysed."""
        rows = self._proof(self.published_assertions().where(F.col("assertion_id") == caller_id)).where("path IS NOT NULL")
        return self._cited(rows.join(self.tables["runs"].select("run_id", "commit"), "run_id"))

    def _cited(self, rows: DataFrame) -> DataFrame:
        """Adds the cited lines from the tree: null where the content is not there or is no text."""
        text = self.table("tree").select("repo", "commit", "path", F.col("content").cast("string").alias("_text"))
        lines = F.split("_text", "\n")
        cited = F.when(F.is_valid_utf8("_text"), F.array_join(F.slice(lines, F.greatest(F.lit(1), F.col("start_line")), F.greatest(F.lit(0), F.col("end_line") - F.col("start_line") + 1)), "\n"))
        return rows.join(text, ["repo", "commit", "path"], "left").withColumn("cited", cited).drop("_text")

    def compare_callers(self, old: str, new: str, level: str = "occurrence") -> DataFrame:
        """Callers of two operations side by side, by place or by analysis unit (which needs the ``units`` table: path, unit)."""
        commits = self.tables["runs"].select("run_id", "commit")

        def side(operation: str) -> DataFrame:
            rows = self.find_operation_consumers(operation).where("path IS NOT NULL").join(commits, "run_id")
            if level == "unit":
                owned = C.attribute_units(rows.select(F.col("assertion_id").alias("site_id"), "path"), self.table("units"))
                rows = rows.join(owned.withColumnRenamed("site_id", "assertion_id").dropDuplicates(["assertion_id"]), "assertion_id")
                rows = rows.withColumn("unit_state", F.col("attribution")).withColumn("units", F.transform("units", lambda u: F.struct(u.alias("id"), F.lit("").alias("metadata"))))
            return change.caller_identities(rows, level).select("key", "unresolved", "assertion_id")

        return change.compare_callers(side(old), side(new), "key", F.col("unresolved"), "assertion_id")

    def _participation(self) -> DataFrame:
        placed = services.placements(self.table("files"), self.table("memberships"))
        return services.participation(self.table("edges"), placed).join(self.table("edges").select("edge_id", "kind"), "edge_id")

    def relationships(self, service_key: str, view: str = "all") -> DataFrame:
        return services.relationship_view(self._participation().where(F.col("service_key") == service_key), view)

    def relationship_snapshot(self, service_key: str) -> DataFrame:
        """Edges of a service with its part in them and the services on the other side."""
        parts = self._participation()
        return parts.where(F.col("service_key") == service_key).join(services.counterparts(parts), ["edge_id", "service_key"], "left")

    def compare_relationships(self, other: Snapshot, service_key: str) -> DataFrame:
        """Edges added, removed and unchanged from this snapshot to another; an edge is known by its kind and both ends."""
        def digests(s: Snapshot) -> DataFrame:
            edges = s.relationships(service_key).select("edge_id").join(s.table("edges"), "edge_id")
            return edges.select(F.sha2(F.concat_ws("\0", "kind", "repo", "source_path", "target_path"), 256).alias("digest"))

        return change.compare_by_digest(digests(self), digests(other), "digest")

    def relationship_citation(self, edge_id: str) -> DataFrame:
        """The lines an edge rests on (edges with commit, start_line and end_line)."""
        return self._cited(self.table("edges").where(F.col("edge_id") == edge_id).withColumnRenamed("source_path", "path"))

    def list_services(self, status: str | None = None, limit: int = 50, cursor: str | None = None) -> DataFrame:
        rows = self.table("service_states")
        if status:
            rows = rows.where(F.col("status") == status)
        return paging.page_with_more(rows, ["service_key"], limit, [cursor] if cursor else None)

    def service(self, service_key: str) -> DataFrame:
        """State of one service, its paths by role and disposition, and its edges by kind and part."""
        paths = self.table("memberships").where(F.col("service_key") == service_key).groupBy("service_key").agg(F.array_sort(F.collect_set(F.struct("repo", "path"))).alias("paths"))
        edges = self.relationships(service_key).select("service_key", "kind", F.explode("participation").alias("end")).groupBy("service_key").agg(
            F.count_if((F.col("end") == "source") & (F.col("kind") == "rpc")).alias("dependencies"), F.count_if((F.col("end") == "target") & (F.col("kind") == "rpc")).alias("callers"), F.count_if(F.col("kind") == "kafka").alias("topics")
        )
        none = F.lit(0).cast("long")
        found = self.table("service_states").where(F.col("service_key") == service_key).join(paths, "service_key", "left").join(edges, "service_key", "left")
        return found.select("*", *[F.coalesce(c, none).alias(f"n_{c}") for c in ("dependencies", "callers", "topics")]).drop("dependencies", "callers", "topics")

    # navigation: occurrences (repo, commit, path, range, symbol, roles), symbols, symbol_relationships

    def _at(self, repo: str, commit: str, path: str, line: int, column: int) -> tuple[DataFrame, DataFrame]:
        rows = self.table("symbol_occurrences").where((F.col("repo") == repo) & (F.col("commit") == commit))
        return codenav.at_position(rows, path, line, column), rows

    def find_definitions(self, repo: str, commit: str, path: str, line: int, column: int) -> DataFrame:
        symbols, rows = self._at(repo, commit, path, line, column)
        return codenav.definitions(symbols, rows, self.tables["symbol_relationships"])

    def find_references(self, repo: str, commit: str, path: str, line: int, column: int, limit: int = REFERENCES_MOST) -> DataFrame:
        symbols, rows = self._at(repo, commit, path, line, column)
        return codenav.find_references(symbols, rows, self.tables["symbol_relationships"], min(max(limit, 1), REFERENCES_MOST))

    def hover(self, repo: str, commit: str, path: str, line: int, column: int) -> DataFrame:
        symbols, rows = self._at(repo, commit, path, line, column)
        return codenav.hover(symbols, self.tables["symbols"], rows)

    # history: tables as read by the git sources

    def commits(self, repo: str, offset: int = 0, limit: int = 50) -> DataFrame:
        return sources.commit_page(self.table("log").where(F.col("repo") == repo), offset, limit)

    def commit(self, repo: str, commit: str) -> DataFrame:
        """One commit with its totals and changed files."""
        rows = self.table("log").where((F.col("repo") == repo) & (F.col("commit") == commit))
        return rows.join(sources.change_totals(rows), ["repo", "commit"])

    def diff(self, repo: str, commit: str, path: str | None = None) -> DataFrame:
        """Changed files of a commit with their hunks."""
        rows = self.table("diffs").where((F.col("repo") == repo) & (F.col("commit") == commit))
        return rows if path is None else rows.where((F.col("path") == path) | (F.col("old_path") == path))

    # operation

    def usage(self, first_day: str, last_day: str, ts: str = "ts", duration: str = "duration_ms", name: str = "name", top: int = 10) -> dict[str, DataFrame]:
        """Totals, every day of the range, and the most frequent names."""
        rows = self.table("usage")
        return {"summary": analytics.usage_summary(rows, duration), "daily": analytics.daily_counts(rows, ts, first_day, last_day), "top": analytics.top_names(rows, name, top)}

    def audit(self, limit: int = 50, cursor: list | None = None) -> DataFrame:
        """Audit events, newest first."""
        return paging.page_with_more(self.table("audit").withColumn("_age", -F.unix_micros(F.col("created_at").cast("timestamp"))), ["_age", "event_id"], limit, cursor)

    def retention_status(self, now: str, keep_days: int) -> DataFrame:
        """Per status of a run: how many, how many are past retention, and how many of these a pin keeps."""
        cutoff = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(keep_days)} DAYS")
        pinned = self.tables["pins"].select("run_id").distinct().withColumn("_pinned", F.lit(True))
        dead = F.col("status").isin("superseded", "aborted") & (F.col("started_at") <= cutoff)
        rows = self.table("runs").join(pinned, "run_id", "left").withColumn("_dead", F.coalesce(dead, F.lit(False)))
        return rows.groupBy("status").agg(F.count("*").alias("runs"), F.count_if("_dead").alias("expired"), F.count_if(F.col("_dead") & F.col("_pinned").isNotNull()).alias("pinned"), F.min("started_at").alias("oldest"))

    def lifecycle_status(self) -> DataFrame:
        """Per repository its latest attempt, latest published run and how many attempts failed since."""
        runs = self.table("runs")
        tried = evidence.latest_attempt(runs, ["repo"]).select("repo", F.col("run_id").alias("attempt_run"), F.col("status").alias("attempt_status"))
        done = evidence.latest_published(runs, ["repo"]).select("repo", F.col("run_id").alias("published_run"), F.col("started_at").alias("_since"))
        failed = runs.where("status = 'aborted'").join(done, "repo", "left").where("_since IS NULL OR started_at > _since").groupBy("repo").agg(F.count("*").alias("failed_since"))
        repos = self.visible_repos().select(F.col("name").alias("repo"))
        return repos.join(tried, "repo", "left").join(done.drop("_since"), "repo", "left").join(failed, "repo", "left").withColumn("failed_since", F.coalesce("failed_since", F.lit(0).cast("long")))

    def observation_progress(self) -> DataFrame:
        """Per repository: files observed, not supported and still waiting."""
        o = self.table("observations")
        return o.groupBy("repo").agg(*[F.count_if(F.col("state") == x).alias(x) for x in ("observed", "unsupported", "pending")], F.count("*").alias("files"))

    # investigations

    def consumer_ledger(self) -> DataFrame:
        """First and last sight of every consumer over the recorded snapshots."""
        return change.ledger(self.table("consumer_observations"), "consumer", "sequence", self.tables["consumer_snapshots"])

    def review(self, before: DataFrame, after: DataFrame, comparable: bool = True) -> DataFrame:
        """What a reviewer should look at: consumers that are new, scopes whose coverage became worse, rows that stay unresolved."""
        added = change.consumer_delta(before, after, "consumer", comparable).where("change = 'added'").select(F.col("consumer").alias("item"))
        worse = self.coverage().where(F.col("state").isin("stale", "failed")).select(F.concat_ws("/", "repo", "domain").alias("item"))
        open_rows = self.published_assertions().where(F.col("predicate").startswith("UNRESOLVED_")).select(F.col("subject").alias("item"))
        return change.review_queue({"new_consumers": added, "coverage_regression": worse, "unresolved_attribution": open_rows}, ["item"])

    def workbench(self, operation: str, service_key: str) -> DataFrame:
        """Impact of an operation joined with the placement of each row: whether the service owns it, and the coverage behind it."""
        rows = self.find_operation_consumers(operation)
        owned = services.placements(self.table("files"), self.table("memberships")).where(F.col("placement") == "accepted").select("repo", "path", F.col("service_key").alias("owner")).distinct()
        states = self.coverage(["grpc-consumer", "grpc-caller", "thrift-consumer", "thrift-caller"]).select("repo", "domain", "state")
        placed = rows.join(owned, ["repo", "path"], "left").join(states, ["repo", "domain"], "left")
        return placed.withColumn("owned", F.coalesce(F.col("owner") == service_key, F.lit(False)))

    def checklist(self, operation: str, service_key: str) -> DataFrame:
        """Suggested work for an operation with the latest disposition of each suggestion (table ``dispositions``)."""
        found = C.suggestions(self.workbench(operation, service_key), self.coverage(["grpc-consumer", "grpc-caller", "thrift-consumer", "thrift-caller"]))
        return change.checklist(found.select(F.concat_ws(":", "kind", "subject").alias("suggestion")), self.tables["dispositions"], "suggestion")

    # browsing

    def repos(self) -> DataFrame:
        return self.visible_repos().orderBy("name")

    def folder(self, repo: str, commit: str, parent: str) -> DataFrame:
        return sources.folder(self.table("tree").where((F.col("repo") == repo) & (F.col("commit") == commit)), parent)

    def tree(self, repo: str, commit: str) -> DataFrame:
        return sources.tree(self.table("tree").where((F.col("repo") == repo) & (F.col("commit") == commit)))

    def repo_status(self) -> DataFrame:
        """Repositories with their latest index job."""
        jobs = evidence.latest_per(self.table("jobs"), ["repo"], [F.desc("created_at"), F.asc("job_id")]).select(F.col("repo").alias("name"), F.col("job_id").alias("last_job"), F.col("status").alias("job_status"))
        return self.visible_repos().join(jobs, "name", "left").orderBy("name")

    def source(self, repo: str, commit: str, path: str) -> DataFrame:
        return sources.source(self.table("tree"), repo, commit, path)
