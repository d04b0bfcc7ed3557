"""Closed vocabularies and default limits."""

# Fixed values
DISPOSITIONS = ("accepted", "proposal", "conflict", "rejected")
MEMBERSHIP_ROLES = ("primary", "supporting", "shared", "generated", "typed")
SERVICE_STATUSES = ("current", "stale", "unavailable", "conflict", "removed")
KAFKA_ABSTENTIONS = ("ambiguous-library-import", "call-expr", "invalid-topic-literal", "non-literal-expr", "selector-expr", "unresolved-ident")
DOMAINS = ("proto-contract", "thrift-contract", "grpc-consumer", "thrift-consumer", "grpc-caller", "thrift-caller", "kafka-producer", "kafka-consumer", "scip-proto-field", "scip-thrift-field")
PROTOCOLS = {"proto-contract": "grpc", "grpc-consumer": "grpc", "grpc-caller": "grpc", "scip-proto-field": "grpc", "thrift-contract": "thrift", "thrift-consumer": "thrift", "thrift-caller": "thrift", "scip-thrift-field": "thrift"}

# Default and largest limits
SEARCH_FILES_DEFAULT, SEARCH_FILES_MOST, CONTEXT_LINES_MOST = 50, 500, 10
CALLER_PAGE_DEFAULT, CALLER_PAGE_MOST = 50, 100
CENSUS_ASSERTIONS_MOST = 5_000
EVIDENCE_PAGE_MOST = 500
SHAPE_DEPTH_MOST, SHAPE_NODES_MOST, SHAPE_FIELDS_MOST = 6, 256, 100
REFERENCES_MOST = 500
COMPARISON_SAMPLES = 4
