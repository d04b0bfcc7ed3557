"""Facts from Go source text: Kafka topic sites, RPC registrations and call sites.

A scanner over the text, not a type checker: it recognises the closed list of library shapes, resolves a topic only from a string
literal or a constant of the same file, and abstains with a reason otherwise. Tiers say how far a shape can be trusted.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seine.runtime import ship

# Import paths of the recognised libraries
SARAMA = ("github.com/IBM/sarama", "github.com/Shopify/sarama")
SEGMENTIO = ("github.com/segmentio/kafka-go",)

SITE_COLUMNS = "plane string, topic string, reason string, library string, shape string, tier string, line int"
_COMMENT = re.compile(r'"(?:\\.|[^"\\\n])*"|`[^`]*`|//[^\n]*|/\*.*?\*/', re.S)
_IMPORT = re.compile(r'^\s*(?:import\s+)?(?:([\w.]+)\s+)?"([^"\n]+)"\s*$', re.M)
_CONST = re.compile(r'^\s*(?:const\s+)?(\w+)\s*(?:string\s*)?=\s*"((?:\\.|[^"\\\n])*)"', re.M)


def strip_comments(text: str) -> str:
    """Comments become blanks; strings and line numbers stay."""
    return _COMMENT.sub(lambda m: m[0] if m[0][0] in "\"`" else re.sub(r"[^\n]", " ", m[0]), text)


def line_counter(text: str) -> Callable[[int], int]:
    """Line of a position, looked up among the line ends, which are found once."""
    ends = [m.start() for m in re.finditer("\n", text)]
    return lambda at: bisect_right(ends, at - 1) + 1


def imports(text: str) -> dict[str, str]:
    """Local name -> import path."""
    head = text.split("\nfunc ", 1)[0]
    return {(m[1] or m[2].rpartition("/")[2]): m[2] for m in _IMPORT.finditer(head)}


def _topic(expr: str, constants: dict[str, str]) -> tuple[str | None, str | None]:
    expr = expr.strip()
    literal = re.fullmatch(r'"((?:\\.|[^"\\])*)"|`([^`]*)`', expr)
    if literal:
        value = literal[1] if literal[1] is not None else literal[2]
        return (value, None) if re.fullmatch(r"[A-Za-z0-9._-]{1,249}", value) and value not in (".", "..") else (None, "invalid-topic-literal")
    if re.fullmatch(r"\w+", expr):
        return (constants[expr], None) if expr in constants else (None, "unresolved-ident")
    if re.fullmatch(r"[\w.]+", expr):
        return None, "selector-expr"
    return None, "call-expr" if re.match(r"[\w.]+\(", expr) else "non-literal-expr"


def _balanced(text: str, at: int) -> str:
    """The text inside the bracket that opens at ``at``."""
    close = {"{": "}", "(": ")", "[": "]"}
    stack = [close[text[at]]]
    i = at + 1
    while i < len(text) and stack:
        c = text[i]
        if c in "\"`":
            end = text.find(c, i + 1)
            while c == '"' and end > 0 and text[end - 1] == "\\":
                end = text.find(c, end + 1)
            i = end if end > 0 else len(text)
        elif c in close:
            stack.append(close[c])
        elif c == stack[-1]:
            stack.pop()
        i += 1
    return text[at + 1 : i - 1]


def _split(args: str) -> list[str]:
    out, depth, current, quote = [], 0, "", ""
    for c in args:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"`":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        if c == "," and not depth and not quote:
            out.append(current)
            current = ""
        else:
            current += c
    return [*out, current] if current.strip() else out


def _elements(expr: str) -> list[str]:
    brace = expr.find("{")
    return _split(_balanced(expr, brace)) if "[]string" in expr and brace >= 0 else [expr]


def kafka_sites(source: str) -> Iterator[tuple]:
    """Producer and consumer topic sites of one file."""
    text = strip_comments(source)
    names = imports(text)
    sarama = [n for n, p in names.items() if p in SARAMA]
    segment = [n for n, p in names.items() if p in SEGMENTIO]
    constants = {m[1]: m[2] for m in _CONST.finditer(text)}
    several = len({p for p in names.values() if p in SARAMA}) > 1
    line = line_counter(text)

    def emit(plane: str, expr: str, library: str, shape: str, tier: str, at: int) -> tuple:
        topic, reason = (None, "ambiguous-library-import") if library == "sarama" and several else _topic(expr, constants)
        return plane, topic, reason, library, shape, tier if topic else "unresolved", line(at)

    def composites(aliases: list[str], kind: str) -> Iterator[tuple[int, dict[str, str]]]:
        for m in re.finditer(rf"\b(?:{'|'.join(map(re.escape, aliases))})\.{kind}\s*\{{", text) if aliases else ():
            body = _balanced(text, m.end() - 1)
            yield m.start(), {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in _split(body))}

    for at, body in composites(sarama, "ProducerMessage"):
        if "Topic" in body:
            yield emit("producer", body["Topic"], "sarama", "ProducerMessage", "derived", at)
    for kind in ("Writer", "WriterConfig"):
        for at, body in composites(segment, kind):
            if "Topic" in body:
                yield emit("producer", body["Topic"], "segmentio", kind, "derived", at)
    for m in re.finditer(r"\.WriteMessages\s*\(", text) if segment else ():
        args = _balanced(text, m.end() - 1)
        for x in re.finditer(rf"\b(?:{'|'.join(map(re.escape, segment))})\.Message\s*\{{", args):
            body = {k.strip(): v.strip() for k, _, v in (y.partition(":") for y in _split(_balanced(args, x.end() - 1)))}
            if "Topic" in body:
                yield emit("producer", body["Topic"], "segmentio", "Message", "derived", m.start())
    for at, body in composites(segment, "ReaderConfig"):
        for expr in [body["Topic"]] if "Topic" in body else _elements(body["GroupTopics"]) if "GroupTopics" in body else []:
            yield emit("consumer", expr, "segmentio", "ReaderConfig", "derived", at)
    if sarama:
        for m in re.finditer(r"\.(Consume|ConsumePartition)\s*\(", text):
            args = _split(_balanced(text, m.end() - 1))
            if m[1] == "Consume" and len(args) == 3:
                for expr in _elements(args[1]):
                    yield emit("consumer", expr, "sarama", "Consume", "heuristic", m.start())
            elif m[1] == "ConsumePartition" and len(args) == 3:
                yield emit("consumer", args[0], "sarama", "ConsumePartition", "heuristic", m.start())


CALL_COLUMNS = "kind string, receiver string, method string, container string, line int"
_FUNC = re.compile(r"^func\s*(?:\(\s*(\w+)?\s*\*?([\w.]+)[^)]*\)\s*)?(\w+)\s*\(", re.M)
_CALL = re.compile(r"\b((?:\w+\.)+)([A-Z]\w*)\s*\(")
_REGISTER = re.compile(r"\b(?:\w+\.)?Register(\w+)Server\s*\(")
_STUB = re.compile(r'\.Invoke\s*\(\s*\w+\s*,\s*"(/[\w.]+/\w+)"')


def call_sites(source: str) -> Iterator[tuple]:
    """Functions, generated stub methods, server registrations and selector calls of one file."""
    text = strip_comments(source)
    opened = [(m.start(), f"{m[2]}.{m[3]}" if m[2] else m[3], m[2], m[3]) for m in _FUNC.finditer(text)]

    line, begins = line_counter(text), [begin for begin, _, _, _ in opened]

    def container(at: int) -> str | None:
        k = bisect_right(begins, at)
        return opened[k - 1][1] if k else None

    for at, _, receiver, name in opened:
        yield "function", receiver, name, None, line(at)
    for m in _STUB.finditer(text):
        yield "stub", None, m[1], container(m.start()), line(m.start())
    for m in _REGISTER.finditer(text):
        if not (container(m.start()) or "").startswith("Register"):
            yield "registration", None, m[1], container(m.start()), line(m.start())
    for m in _CALL.finditer(text):
        yield "call", m[1].rstrip("."), m[2], container(m.start()), line(m.start())


def _scan(files: DataFrame, key: str, content: str, reader, columns: str, types: list[pa.DataType]) -> DataFrame:
    ship(files.sparkSession)
    names = ["blob", *(c.split()[0] for c in columns.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(blob, *r) for blob, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in reader(text)]
            data = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(data, [pa.string(), *types])], names=names)

    placed = files.where(F.col(content).isNotNull()).select(F.col(key).alias("key"), F.sha2(content, 256).alias("blob"), F.col(content).alias("content"))
    found = placed.select("blob", "content").dropDuplicates(["blob"]).mapInArrow(run, f"blob string, {columns}")
    return placed.select("key", "blob").join(found, "blob")


def scan_kafka(files: DataFrame, key: str, content: str) -> DataFrame:
    return _scan(files, key, content, kafka_sites, SITE_COLUMNS, [pa.string()] * 6 + [pa.int32()])


def scan_calls(files: DataFrame, key: str, content: str) -> DataFrame:
    return _scan(files, key, content, call_sites, CALL_COLUMNS, [pa.string()] * 4 + [pa.int32()])


def consumer_facts(sites: DataFrame) -> DataFrame:
    """Calls met with the stub index by method name: resolved, or abstained where several services declare the method."""
    from seine.operators.postings import resolve_exactly_one

    stubs = sites.where("kind = 'stub'").select(F.substring_index("method", "/", -1).alias("method"), F.col("method").alias("operation"))
    calls = sites.where("kind = 'call'").select("key", "receiver", "method", "container", "line")
    found = resolve_exactly_one(calls, stubs, ["method"], "operation")
    return found.withColumn("predicate", F.when(F.col("class") == "resolved", "CALLS_OPERATION").otherwise("UNRESOLVED_CALL"))


def uncovered(fallback: DataFrame, typed: DataFrame) -> DataFrame:
    """Fallback facts whose line no typed fact of the same file covers."""
    return fallback.join(typed.select("key", "line").distinct(), ["key", "line"], "left_anti")
