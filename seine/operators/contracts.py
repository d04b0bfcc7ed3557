"""Contract declarations from .proto and .thrift text, and the compatibility of two versions.

Extraction reads the text with a small scanner in Arrow batches, once per distinct content; what it cannot read becomes a gap
row, never a guess. The compatibility check is a full outer join on the field's key.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seine.runtime import ship

FACT_COLUMNS = "predicate string, subject string, object string, name string, number int, type string, label string, line int"
_FACT_TYPES = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32()]
_THRIFT_TOKEN = re.compile(r'//[^\n]*|#[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'|[A-Za-z_][\w.]*|[-+]?\d[\w.]*|[{}()\[\];=<>,:*&-]|\S', re.S | re.A)
# what is none of a language's tokens becomes a token of its own, so that a name with a foreign letter is never read as another name
_PROTO_TOKEN = re.compile(r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|[A-Za-z_][\w.]*|\.[A-Za-z_][\w.]*|-?\d[\w.]*|[{}()\[\];=<>,:\-+/]|\S', re.S | re.A)
_SCALARS = {"double", "float", "int32", "int64", "uint32", "uint64", "sint32", "sint64", "fixed32", "fixed64", "sfixed32", "sfixed64", "bool", "string", "bytes"}
Fact = tuple[str, str, str | None, str | None, int | None, str | None, str | None, int]


def _tokens(text: str, pattern: re.Pattern, comments: tuple[str, ...]) -> list[tuple[str, int]]:
    out, line, at = [], 1, 0
    for m in pattern.finditer(text):
        line += text.count("\n", at, m.start())
        at = m.start()
        if not m[0].startswith(comments):
            out.append((m[0], line))
    return out


class _Scanner:
    def __init__(self, text: str, pattern: re.Pattern = _PROTO_TOKEN, comments: tuple[str, ...] = ("//", "/*")) -> None:
        self.tokens, self.at = _tokens(text, pattern, comments), 0

    def peek(self, ahead: int = 0) -> str:
        i = self.at + ahead
        return self.tokens[i][0] if i < len(self.tokens) else ""

    def line(self) -> int:
        return self.tokens[min(self.at, len(self.tokens) - 1)][1] if self.tokens else 1

    def take(self) -> str:
        t = self.peek()
        self.at += 1
        return t

    def skip_statement(self) -> None:
        """To the end of a statement, over a whole block if it has one; the end of the enclosing block is left."""
        depth = 0
        while self.at < len(self.tokens):
            if not depth and self.peek() == "}":
                return
            t = self.take()
            if t == "{":
                depth += 1
            elif t == "}":
                depth -= 1
                if not depth:
                    return
            elif t == ";" and depth == 0:
                return

    def bracketed(self) -> list[str]:
        """The tokens of a bracket that opens here, both brackets included."""
        close, depth, out = {"{": "}", "(": ")", "[": "]", "<": ">"}, 0, []
        opening = self.peek()
        while self.at < len(self.tokens):
            out.append(self.take())
            depth += (out[-1] == opening) - (out[-1] == close[opening])
            if not depth:
                break
        return out

    def until(self, end: str) -> list[str]:
        out = []
        while self.peek() not in (end, ""):
            out.append(self.take())
        self.take()
        return out


def proto_facts(text: str) -> Iterator[Fact]:
    """Services, operations, messages and fields declared in one .proto file."""
    s, package = _Scanner(text), ""

    def named(scope: str, name: str) -> str:
        return f"{scope}.{name}" if scope else name

    def field(message: str) -> Iterator[Fact]:
        line, label = s.line(), ""
        if s.peek() in ("optional", "required", "repeated") and s.peek(1) not in ("=", ""):
            label = s.take()
        if s.peek() == "map" and s.peek(1) == "<":
            s.take()
            s.take()
            kind, label = "map<" + "".join(s.until(">")) + ">", "repeated"
        else:
            kind = s.take()
        name = s.take() if s.peek() not in (";", "}") else ""
        if s.peek() == "=" and re.fullmatch(r"\d+|0x[0-9a-fA-F]+", s.peek(1)):
            s.take()
            number = int(s.take(), 0)
            if kind == "group":
                # a group declares a field and, under its own name, the message the field holds
                yield "DECLARES_FIELD", message, f"{message}#{number}", name.lower(), number, name, label, line
                if s.peek() == "[":
                    s.bracketed()
                if s.peek() == "{":
                    yield from body(named(message, name), line)
                    return
            else:
                yield "DECLARES_FIELD", message, f"{message}#{number}", name, number, kind, label, line
        else:
            yield "GAP", message, None, name, None, "unreadable_field", None, line
        s.skip_statement()

    def message(scope: str) -> Iterator[Fact]:
        line, full = s.line(), named(scope, s.take())
        yield from body(full, line)

    def body(full: str, line: int) -> Iterator[Fact]:
        yield "DECLARES_MESSAGE", full, full, full.rpartition(".")[2], None, None, None, line
        s.take()  # {
        depth = 1
        while s.at < len(s.tokens):
            t = s.peek()
            if t == "}":
                s.take()
                depth -= 1
                if not depth:
                    return
            elif t == "message" and s.peek(2) == "{":
                s.take()
                yield from message(full)
            elif t == "oneof" and s.peek(2) == "{":
                s.at += 3
                depth += 1
            elif t == "extend" and s.peek(2) == "{":
                yield "GAP", full, None, s.peek(1), None, "extension", None, s.line()
                s.skip_statement()
            elif t == "enum" and s.peek(2) == "{" or t in ("option", "reserved", "extensions") and s.peek(2) != "=":
                s.skip_statement()
            elif t == ";":
                s.take()
            else:
                yield from field(full)

    def service() -> Iterator[Fact]:
        line, full = s.line(), named(package, s.take())
        yield "DECLARES_SERVICE", full, full, full.rpartition(".")[2], None, None, None, line
        s.take()  # {
        while s.at < len(s.tokens):
            t, line = s.take(), s.line()
            if t == "}":
                return
            if t == "rpc":
                name = s.take()
                s.take()  # (
                asked = s.until(")")
                s.take()  # returns
                s.take()  # (
                answer = s.until(")")
                yield "DECLARES_OPERATION", full, f"/{full}/{name}", name, None, f"{asked[-1] if asked else ''}->{answer[-1] if answer else ''}", "stream" if "stream" in (*asked[:1], *answer[:1]) else "", line
                if s.peek() == "{":
                    s.skip_statement()
            elif t == "option":
                s.skip_statement()

    while s.at < len(s.tokens):
        t = s.peek()
        if t == "package":
            s.take()
            package = s.take()
            if s.peek() != ";":
                yield "GAP", package, None, None, None, "unreadable_package", None, s.line()
            s.skip_statement()
        elif t == "message" and s.peek(2) == "{":
            s.take()
            yield from message(package)
        elif t == "service" and s.peek(2) == "{":
            s.take()
            yield from service()
        elif t == "}":
            s.take()
        elif t == "extend" and s.peek(2) == "{":
            yield "GAP", package, None, s.peek(1), None, "extension", None, s.line()
            s.skip_statement()
        elif t == "enum" and s.peek(2) == "{" or t in ("syntax", "edition", "import", "option"):
            s.skip_statement()
        elif t == ";":
            s.take()
        else:
            # what is no statement is left at the next semicolon or before the next block
            yield "GAP", package, None, None, None, f"unreadable_{t if t in ('message', 'service', 'enum', 'extend') else 'statement'}", None, s.line()
            s.take()
            while s.at < len(s.tokens) and not (s.peek() in ("message", "service", "enum", "extend") and s.peek(2) == "{"):
                if s.take() == ";":
                    break


_NAME = re.compile(r"[A-Za-z_][\w.]*", re.A)


def thrift_facts(text: str) -> Iterator[Fact]:
    """Services, operations (with the structs of their arguments and results), structs, fields and typedefs of one .thrift file.

    Fields without a number, and statements that cannot be read, become gap rows.
    """
    s = _Scanner(text, _THRIFT_TOKEN, ("//", "#", "/*"))
    scopes: dict[str, str] = {}

    def kind() -> str:
        out = s.take()
        if s.peek() == "cpp_type":
            s.at += 2
        if s.peek() == "<":
            s.take()
            inner = [kind()]
            while s.peek() == ",":
                s.take()
                inner.append(kind())
            if s.take() != ">":
                raise ValueError("unclosed container type")
            out += "<" + ",".join(inner) + ">"
        if s.peek() == "cpp_type":
            s.at += 2
        if s.peek() == "(":
            s.bracketed()
        return out

    def value() -> None:
        if s.peek() in ("[", "{"):
            s.bracketed()
        else:
            s.take()

    def separator() -> None:
        if s.peek() == "(":
            s.bracketed()
        if s.peek() in (",", ";"):
            s.take()

    def fields(owner: str, end: str) -> Iterator[Fact]:
        while s.peek() not in (end, ""):
            line, number = s.line(), None
            if re.fullmatch(r"[-+]?\d+", s.peek()) and s.peek(1) == ":":
                number = int(s.take())
                s.take()
            label = s.take() if s.peek() in ("required", "optional") else ""
            type_name = kind()
            while s.peek() in ("&", "*"):
                s.take()
            name = s.take()
            if not _NAME.fullmatch(type_name.partition("<")[0]) or not _NAME.fullmatch(name):
                raise ValueError("no field")
            if s.peek() == "=":
                s.take()
                value()
            separator()
            if number is None:
                yield "GAP", owner, None, name, None, "unnumbered_field", None, line
            else:
                yield "DECLARES_FIELD", owner, f"{owner}#{number}", name, number, type_name, label, line
        s.take()

    def operations(full: str) -> Iterator[Fact]:
        while s.peek() not in ("}", ""):
            line = s.line()
            label = s.take() if s.peek() == "oneway" else ""
            answer, name = kind(), s.take()
            if s.take() != "(":
                raise ValueError("no operation")
            asked, result = f"{full}_{name}_args", f"{full}_{name}_result"
            yield "DECLARES_OPERATION", full, f"/{full}/{name}", name, None, f"{asked}->{answer}", label, line
            yield from fields(asked, ")")
            if not label and answer != "void":
                yield "DECLARES_FIELD", result, f"{result}#0", "success", 0, answer, "", line
            if s.peek() == "throws":
                s.at += 2
                yield from fields(result, ")")
            separator()
        s.take()

    def definition(word: str) -> Iterator[Fact]:
        line, package = s.line(), scopes.get("go") or scopes.get("*") or ""
        s.take()
        if word == "namespace":
            scope = s.take()
            scopes[scope] = s.take()
        elif word == "typedef":
            target, alias = kind(), s.take()
            yield "DECLARES_ALIAS", f"{package}.{alias}".strip("."), target, alias, None, None, None, line
        elif word == "const":
            kind()
            s.take()
            if s.take() == "=":
                value()
        elif word in ("enum", "senum"):
            s.take()
            s.bracketed()
        elif word in ("struct", "union", "exception", "service"):
            name = s.take()
            full = f"{package}.{name}".strip(".")
            if s.peek() == "extends":
                s.at += 2
            if s.take() != "{":
                raise ValueError("no body")
            if word == "service":
                yield "DECLARES_SERVICE", full, full, name, None, None, None, line
                yield from operations(full)
            else:
                yield "DECLARES_MESSAGE", full, full, name, None, word, None, line
                yield from fields(full, "}")
        elif word in ("include", "cpp_include"):
            s.take()
        else:
            raise ValueError("unknown statement")
        separator()

    words = ("namespace", "typedef", "const", "enum", "senum", "struct", "union", "exception", "service", "include", "cpp_include")
    while s.at < len(s.tokens):
        word, line, begin = s.peek(), s.line(), s.at
        try:
            yield from definition(word)
        except ValueError:
            # nothing is sure until the next word that begins a statement
            s.at = begin + 1
            yield "GAP", scopes.get("go") or scopes.get("*") or "", None, None, None, f"unreadable_{word if word in words else 'statement'}", None, line
            while s.at < len(s.tokens) and s.peek() not in words:
                s.take()


_READERS = {"proto": proto_facts, "thrift": thrift_facts}


def extract_facts(files: DataFrame, key: str, content: str, reader: str) -> DataFrame:
    """(key, fact columns) of every file: distinct contents are read once, then met again by digest.

    Null contents give no rows; a file that breaks the scanner gives one GAP row.
    """
    read = _READERS[reader]
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for blob, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows += [(blob, *f) for f in read(text)]
                except (IndexError, ValueError, RecursionError):
                    rows.append((blob, "GAP", "", None, None, None, "unreadable_file", None, 1))
            columns = list(zip(*rows)) if rows else [[]] * 9
            types = [pa.string(), *_FACT_TYPES]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["blob", *(c.split()[0] for c in FACT_COLUMNS.split(", "))])

    placed = files.where(F.col(content).isNotNull()).select(F.col(key).alias("key"), F.sha2(content, 256).alias("blob"), F.col(content).alias("content"))
    facts = placed.select("blob", "content").dropDuplicates(["blob"]).mapInArrow(run, f"blob string, {FACT_COLUMNS}")
    return placed.select("key", "blob").join(facts, "blob")


def parse_with_reuse(contents: DataFrame, known: DataFrame, digest: str) -> tuple[DataFrame, DataFrame]:
    """(contents to parse, contents whose observations are reused), by content digest."""
    return contents.join(known.select(digest).distinct(), digest, "left_anti"), contents.join(known.select(digest).distinct(), digest, "left_semi")


def violations(before: DataFrame, after: DataFrame) -> DataFrame:
    """Wire-breaking differences of two field sets (message, number, name, type, label): rule, message, number, detail."""
    b = before.select("message", "number", *[F.col(c).alias(f"b_{c}") for c in ("name", "type", "label")])
    a = after.select("message", "number", *[F.col(c).alias(f"a_{c}") for c in ("name", "type", "label")])
    kept = before.select("message").distinct().join(after.select("message").distinct(), "message", "left_anti").select(F.col("message").alias("gone"))
    rows = b.join(a, ["message", "number"], "full_outer").join(kept, F.col("message") == F.col("gone"), "left")
    removed, added = F.col("a_name").isNull(), F.col("b_name").isNull()

    def rule(when: Column, name: str, detail: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("rule"), detail.alias("detail")))

    found = F.array_compact(
        F.array(
            rule(removed & F.col("gone").isNotNull(), "MESSAGE_REMOVED", F.col("b_name")),
            rule(removed & F.col("gone").isNull(), "FIELD_REMOVED", F.col("b_name")),
            rule(~removed & ~added & (F.col("a_type") != F.col("b_type")), "FIELD_TYPE_CHANGED", F.concat_ws("->", "b_type", "a_type")),
            rule(~removed & ~added & (F.coalesce("a_label", F.lit("")) != F.coalesce("b_label", F.lit(""))), "FIELD_LABEL_CHANGED", F.concat_ws("->", "b_label", "a_label")),
            rule(~removed & ~added & (F.col("a_name") != F.col("b_name")), "FIELD_NAME_CHANGED", F.concat_ws("->", "b_name", "a_name")),
        )
    )
    return rows.select("message", "number", F.inline(found))


def affected_fields(found: DataFrame) -> DataFrame:
    return found.select("message", "number").distinct()


def match_declarations(findings: DataFrame, spans: DataFrame, bucket: int = 64) -> DataFrame:
    """Findings (path, line) to the declaration spans (path, start_line, end_line, field_id) that hold them (end exclusive).

    A range join by line buckets: spans are entered in each bucket they touch, findings look into one.
    """
    entered = spans.select("*", F.explode(F.sequence(F.floor(F.col("start_line") / bucket), F.floor(F.greatest(F.col("end_line") - 1, F.col("start_line")) / bucket))).alias("_b"))
    looked = findings.withColumn("_b", F.floor(F.col("line") / bucket))
    return looked.join(entered, ["path", "_b"]).where((F.col("line") >= F.col("start_line")) & (F.col("line") < F.col("end_line"))).drop("_b")
