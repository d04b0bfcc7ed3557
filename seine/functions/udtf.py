"""Extraction as table functions in SQL: ``SELECT f.path, x.* FROM files f, LATERAL proto_facts(f.content) x``.

The DataFrame forms in ``seine.operators.contracts`` and ``gosource`` read each distinct content once and are the faster way; these
are for ad-hoc SQL. Null content gives no rows; content that breaks a scanner gives one GAP row (contracts) or none (Go).
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from seine.operators.contracts import FACT_COLUMNS, proto_facts, thrift_facts
from seine.operators.gosource import CALL_COLUMNS, SITE_COLUMNS, call_sites, kafka_sites
from seine.runtime import ship

_GAP = ("GAP", "", None, None, None, "unreadable_file", None, 1)


class ProtoFacts:
    def eval(self, content: str):
        if content is not None:
            try:
                yield from proto_facts(content)
            except (IndexError, ValueError, RecursionError):
                yield _GAP


class ThriftFacts:
    def eval(self, content: str):
        if content is not None:
            try:
                yield from thrift_facts(content)
            except (IndexError, ValueError, RecursionError):
                yield _GAP


class KafkaSites:
    def eval(self, content: str):
        if content is not None:
            yield from kafka_sites(content)


class CallSites:
    def eval(self, content: str):
        if content is not None:
            yield from call_sites(content)


TABLE_FUNCTIONS = {"proto_facts": (ProtoFacts, FACT_COLUMNS), "thrift_facts": (ThriftFacts, FACT_COLUMNS), "kafka_sites": (KafkaSites, SITE_COLUMNS), "call_sites": (CallSites, CALL_COLUMNS)}


def register(spark: SparkSession) -> None:
    """Make the table functions known to the session's SQL."""
    ship(spark)
    for name, (reader, columns) in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, udtf(reader, returnType=columns))
