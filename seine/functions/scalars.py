"""Scalar building blocks: identities, digests, buckets, paths, names and small decoders. All run inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), use)[0]


# identities and digests


def identity(prefix: str, *fields: Column) -> Column:
    """Prefixed SHA-256 over length-delimited fields: for each, its byte length, a colon, the field, a semicolon."""
    parts = []
    for f in fields:
        text = f.cast("string")
        parts += [F.octet_length(text).cast("string"), F.lit(":"), text, F.lit(";")]
    return F.concat(F.lit(prefix), F.sha2(F.concat(*parts), 256))


def domain_digest(domain: str, body: Column) -> Column:
    """SHA-256 of the domain name, a zero byte and the body."""
    return F.sha2(F.concat(F.lit(domain), F.lit("\0"), body), 256)


def hash_bucket(value: Column) -> Column:
    """0..255 from the first byte of the value's SHA-256."""
    return F.conv(F.substring(F.sha2(value, 256), 1, 2), 16, 10).cast("int")


def bit_prefix(value: Column, bits: int) -> Column:
    """The first ``bits`` (up to 32) of the value's SHA-256 as a string of 0 and 1."""
    head = F.conv(F.substring(F.sha2(value, 256), 1, 8), 16, 2)
    return F.substring(F.lpad(head, 32, "0"), 1, bits)


# sets and lists


def canonical_set(values: Column) -> Column:
    """Sorted, distinct, without blanks."""
    return F.array_sort(F.array_distinct(F.filter(values, lambda x: F.trim(x) != "")))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def quoted_list(values: Column) -> Column:
    """Sorted distinct JSON list as text."""
    return F.to_json(F.array_sort(F.array_distinct(values)))


# globs and paths


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a shell glob whose ``*`` and ``?`` stop at a slash."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                raise ValueError(f"unclosed class in glob {pattern!r}")
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + body + "]")
            i = end
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def glob_match(value: Column, pattern: str) -> Column:
    return value.rlike(glob_regex(pattern))


def segments(path: Column) -> Column:
    return F.split(path, "/")


def has_segment(path: Column, *names: str) -> Column:
    return F.arrays_overlap(segments(path), F.array(*[F.lit(n) for n in names]))


def valid_path(path: Column) -> Column:
    """Relative, no empty, ``.`` or ``..`` segment, no leading hyphen, no backslash or control character, at most 4,096 bytes."""
    bad = F.exists(segments(path), lambda s: s.isin("", ".", ".."))
    return (path != "") & (F.octet_length(path) <= PATH_BYTES_MOST) & ~path.startswith("-") & ~bad & ~path.rlike(r"[\\\x00-\x1f\x7f]")


def ancestors(path: Column) -> Column:
    """Every ancestor prefix of a path, the path itself included, shortest first."""
    parts = segments(path)
    return let(parts, lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda n: F.array_join(F.slice(p, F.lit(1), n), "/")))


def under_prefix(path: Column, prefix: Column | str) -> Column:
    """The path is the prefix or lies below it."""
    p = F.lit(prefix) if isinstance(prefix, str) else prefix
    return (path == p) | path.startswith(F.concat(p, F.lit("/")))


# Headers that mark generated code and mocks
PATH_BYTES_MOST, HEAD_BYTES = 4096, 4096
MOCK_HEADER = r"Code generated by (MockGen|mockery|counterfeiter)"
GENERATED_HEADER = r"(?m)^(//|#).*(Code generated .* DO NOT EDIT|Autogenerated by Thrift Compiler)"


def code_role(path: Column, content: Column) -> Column:
    """vendor > mock > generated > test > production; headers count within the first 4,096 bytes."""
    # a header cut inside a character ends there; the characters of a header itself are ASCII
    head = F.decode(F.substring(F.encode(content, "UTF-8"), 1, HEAD_BYTES), "ISO-8859-1")
    name = F.substring_index(path, "/", -1)
    mock_name = name.rlike(r"^(mock|fake)_") | name.rlike(r"_(mock|fake)(_test)?\.go$")
    return (
        F.when(has_segment(path, "vendor"), "vendor")
        .when(head.rlike(MOCK_HEADER) | has_segment(path, "mock", "mocks", "mocksgen", "fake", "fakes") | mock_name, "mock")
        .when(head.rlike(GENERATED_HEADER), "generated")
        .when(path.endswith("_test.go") | has_segment(path, "tests", "testing", "testdata"), "test")
        .otherwise("production")
    )


def source_role(path: Column, generated: Column | None = None) -> Column:
    """generated > vendor > test > production, by path alone."""
    made = generated if generated is not None else F.lit(False)
    return F.when(made, "generated").when(has_segment(path, "vendor"), "vendor").when(path.endswith("_test.go") | has_segment(path, "test", "tests", "testdata"), "test").otherwise("production")


def parse_subject(subject: Column) -> Column:
    """struct(path, start_line, end_line) of ``path:start-end``, split at the last colon; null fields if it has another shape."""

    def part(n: int) -> Column:
        found = F.regexp_extract(subject, r"^(.+):(\d{1,9})-(\d{1,9})$", n)
        return F.when(found != "", found)

    return F.struct(part(1).alias("path"), part(2).cast("int").alias("start_line"), part(3).cast("int").alias("end_line"))


# names and addresses


_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*)://"
_SCP_LIKE = r"^(?:[^@/:]+@)?[^@/:]+:(?!//)"


def sanitize_url(url: Column) -> Column:
    """A clone address without query and fragment; null for one that must not be kept.

    HTTP(S) loses its user and needs a host; SSH keeps a user but no password may stand in it; other schemes may have no user.
    Addresses of the form ``user@host:path`` and local paths stay as they are.
    """
    scheme = F.lower(F.regexp_extract(url, _SCHEME, 1))
    bare = F.regexp_replace(url, r"[?#].*$", "")
    authority = F.regexp_extract(bare, _SCHEME + r"([^/]*)", 2)
    user = F.when(authority.contains("@"), F.regexp_extract(authority, "^(.*)@", 1))
    host = F.substring_index(F.substring_index(authority, "@", -1), ":", 1)
    web = F.when(host != "", F.concat(scheme, F.lit("://"), F.substring_index(authority, "@", -1), F.regexp_extract(bare, _SCHEME + r"[^/]*(.*)$", 2)))
    ssh = F.when(user.isNull() | ~user.contains(":"), bare)
    return (
        F.when(url.rlike(_SCP_LIKE) & (scheme == "") | ((scheme == "") & ~url.startswith("//")), url)
        .when(scheme.isin("http", "https"), web)
        .when(scheme.isin("ssh", "git+ssh", "ssh+git", "sftp"), ssh)
        .otherwise(F.when(user.isNull(), bare))
    )


def valid_repo_name(name: Column) -> Column:
    """Segments between slashes, none of them empty, ``.``, ``..`` or with ``.git`` at its end; no leading hyphen, backslash, blank or control."""
    bad = F.exists(segments(name), lambda s: s.isin("", ".", "..") | F.lower(s).endswith(".git") | s.startswith("-"))
    return (name != "") & (F.octet_length(name) <= PATH_BYTES_MOST) & ~bad & ~name.rlike(r"[\\\x00-\x20\x7f]")


def repo_name(url: Column) -> Column:
    """Canonical ``host/owner/name`` of a clone URL, scp-like address, local or home path; null for what is none or gives no valid name."""
    s = F.regexp_replace(F.when(url.startswith("~/"), url).otherwise(sanitize_url(url)), r"\.git$", "")
    local = F.btrim(F.regexp_replace(s, "/+", "/"), F.lit("/"))
    scheme = F.regexp_extract(s, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/]*)(.*)$", 1)
    authority = F.substring_index(scheme, "@", -1)
    rest = F.btrim(F.regexp_extract(s, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/]*)(.*)$", 2), F.lit("/"))
    host = F.regexp_extract(s, r"^(?:[^@/:]*@)?([^/:@]+):(.+)$", 1)
    path = F.btrim(F.regexp_extract(s, r"^(?:[^@/:]*@)?([^/:@]+):(.+)$", 2), F.lit("/"))
    name = (
        F.when(s.startswith("~/"), F.concat(F.lit("local/"), F.regexp_replace(s, "^~/+", "")))
        .when(s.startswith("/"), F.when(local != "", F.concat(F.lit("local/"), local)))
        .when(s.contains("://"), F.when(rest != "", F.concat(F.when(authority == "", "local").otherwise(authority), F.lit("/"), rest)))
        .when((host != "") & (path != ""), F.concat(host, F.lit("/"), path))
    )
    return F.when(valid_repo_name(name), name)


def host_identity(host: Column, login: Column) -> Column:
    return F.lower(F.concat(F.trim(host), F.lit(":"), F.trim(login)))


def valid_topic(topic: Column) -> Column:
    return topic.rlike(r"^[A-Za-z0-9._-]{1,249}$") & ~topic.isin(".", "..")


def camel_case(name: Column) -> Column:
    """Go name of a contract field: underscores go, and a lower-case ASCII letter that begins a part is raised."""
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.array_join(F.transform(F.split(name, "_"), lambda p: F.concat(F.translate(F.substring(p, 1, 1), lower, upper), p.substr(F.lit(2), F.char_length(p)))), "")


def lexical_candidates(scope: Column, name: Column) -> Column:
    """Names to try from the innermost scope outwards; a leading dot means the absolute name only."""
    parts = F.when(scope == "", F.array().cast("array<string>")).otherwise(F.split(scope, r"\."))
    tried = let(parts, lambda p: F.transform(F.sequence(F.lit(0), F.size(p)), lambda k: F.array_join(F.concat(F.slice(p, F.lit(1), F.size(p) - k), F.array(name)), ".")))
    return F.when(name.startswith("."), F.array(name.substr(F.lit(2), F.char_length(name)))).otherwise(tried)


# numbers, dates, text


def clamp(value: Column, default: int, most: int) -> Column:
    return F.when(value.isNull() | (value <= 0), default).otherwise(F.least(value, F.lit(most)))


def clamp_int(value: int | None, default: int, most: int) -> int:
    return default if value is None or value <= 0 else min(value, most)


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def truncated(text: Column, characters: int) -> Column:
    """struct(text, truncated)."""
    return F.struct(F.substring(text, 1, characters).alias("text"), (F.char_length(text) > characters).alias("truncated"))


def valid_utf8(raw: Column) -> Column:
    return F.make_valid_utf8(raw.cast("string"))


def content_body(raw: Column) -> Column:
    """struct(encoding, body): UTF-8 text as it is, other bytes in base64."""
    text = F.is_valid_utf8(raw.cast("string"))
    return F.struct(F.when(text, "utf-8").otherwise("base64").alias("encoding"), F.when(text, raw.cast("string")).otherwise(F.base64(raw)).alias("body"))


def access_class(roles: Column) -> Column:
    """write > read > test > generated > unknown, from the role bits of a symbol occurrence."""

    def has(bit: int) -> Column:
        return roles.bitwiseAND(F.lit(bit)) != 0

    return F.when(has(4), "write").when(has(8), "read").when(has(32), "test").when(has(16), "generated").otherwise("unknown")


def admits_field_number(number: Column, protocol: Column) -> Column:
    """Contract field numbers; for protobuf without the reserved block."""
    proto = number.between(1, 536_870_911) & ~number.between(19_000, 19_999)
    return F.when(protocol == "thrift", number.between(-32_768, 32_767)).otherwise(proto)


def tagged_detail(detail: Column, schema_tag: str, fields: str) -> Column:
    """The detail object, if it is JSON with the expected ``schema`` tag; any other non-empty detail raises."""
    parsed = F.from_json(detail, f"schema string, {fields}")
    return F.when(detail.isNull() | (detail == ""), None).when(parsed["schema"] == schema_tag, parsed).otherwise(F.raise_error(F.concat(F.lit("unexpected detail schema: "), F.coalesce(parsed["schema"], F.lit("none")))).cast(T._parse_datatype_string(f"schema string, {fields}")))


def line_starts(content: Column) -> Column:
    """Byte offset at which each line begins."""
    lines = F.split(content, "\n")
    return F.slice(
        F.aggregate(lines, F.array(F.lit(0)), lambda acc, l: F.concat(acc, F.array(F.element_at(acc, -1) + F.octet_length(l) + 1))),
        F.lit(1), F.size(lines),
    )


def line_of_byte(starts: Column, offset: Column) -> Column:
    """1-based line that holds a byte offset."""
    return F.size(F.filter(starts, lambda s: s <= offset))


def utf16_units(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def byte_of_column(line: Column, column: Column, encoding: Column) -> Column:
    """Byte offset in a line of a 0-based column counted in ``utf-8`` bytes, ``utf-16`` units or ``utf-32`` code points."""
    units = F.substring(F.encode(line, "UTF-16BE"), F.lit(1), column * 2)
    points = F.substring(line, F.lit(1), column)
    return F.when(encoding == "utf-8", column).when(encoding == "utf-16", F.octet_length(F.decode(units, "UTF-16BE"))).when(encoding == "utf-32", F.octet_length(points))


def jittered(base_seconds: float, uniform: float) -> float:
    """Half the base plus a uniform share of it, for retry back-off on the driver."""
    return base_seconds / 2 + uniform * base_seconds
