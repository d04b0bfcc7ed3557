"""Flat tables from deeply nested, irregular JSON records.

A :class:`Node` tree describes which objects of a record become tables. Each table is produced by one ``inline`` over a
higher-order expression: nested ``transform`` calls attach the ancestors' positions, ``flatten`` joins the levels. There is
no shuffle, no schema inference and no Python in the plan.

Defined behaviour
    * A record that is null or not one complete JSON value gives no rows (leading/trailing garbage included).
    * Any part may be missing or null: it gives no rows. A null list element gives no row but keeps its position.
    * A bare object where a list is expected is a list of one.
    * A part written as JSON text (a string holding JSON) counts as the part, however often it is quoted.
    * A part of another type (number, list where an object is expected) gives no rows.
    * Leaf values come out as written: strings unescaped, other values as JSON text (fractions without trailing zeros); JSON null
      is null.
    * Repeated records are independent; extra input columns are ignored unless named in ``keys``; a key column whose name
      clashes with a generated column raises ``ValueError``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_JSON = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}
_BLANK = " \t\r\n"


@dataclass(frozen=True)
class Node:
    """One object of the record, found under ``key`` of its parent; ``many`` if a list of such objects is expected."""

    key: str
    many: bool = False
    fields: Mapping[str, str] = field(default_factory=dict)  # output column -> key in the object
    children: tuple[Node, ...] = ()

    def walk(self, prefix: tuple[Node, ...] = ()) -> Iterator[tuple[Node, ...]]:
        path = (*prefix, self)
        yield path
        for child in self.children:
            yield from child.walk(path)


def table_name(path: tuple[Node, ...]) -> str:
    return ".".join(n.key for n in path)


def position_column(node: Node) -> str:
    return f"{node.key}_pos"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once: the lambda's variable stands for it."""
    return F.transform(F.array(value), use)[0]


def _trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANK))


def _open(text: Column) -> Column:
    """The content of text that is a quoted string; other text as it is."""
    inner = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "v string", _JSON)["v"]
    return F.when(text.startswith('"'), _trimmed(inner)).otherwise(text)


def _opened(text: Column) -> Column:
    """Text opened until it is no quoted string. Quoting doubles the escapes of what it quotes, so depth is below the logarithm of length."""
    depth = F.ceil(F.log2(F.char_length(text) + F.lit(2))).cast("int")
    turns = F.when(text.startswith('"'), F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(turns, text, lambda t, _: _open(t))


def _body(text: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` on the trimmed JSON text, opened if it is quoted."""
    return _let(_trimmed(text), lambda t: _let(_opened(t), use))


def _object(text: Column, keys: list[str]) -> Column:
    schema = ", ".join(f"`{k}` string" for k in keys)
    return _body(text, lambda b: F.from_json(F.when(b.startswith("{"), b), schema, _JSON))


def _list(text: Column) -> Column:
    return _body(text, lambda b: F.when(b.startswith("["), F.from_json(b, "array<string>", _JSON)).when(b.startswith("{"), F.array(b)))


def complete_json(payload: Column) -> Column:
    """``payload`` as JSON text if it is exactly one JSON value (a string is opened), else null.

    ``from_json`` stops reading after the first value, so the text is read as the first of two elements of a list. The second
    is the text's own digest: no text can close the list and hold that digest behind.
    """
    seal = F.md5(payload)
    read = F.from_json(F.concat(F.lit("["), payload, F.lit(',"'), seal, F.lit('"]')), "array<string>", _JSON)
    return _let(read, lambda r: F.when((F.size(r) == 2) & (r[1] == seal), r[0]))


def _keys(node: Node, then: Node | None) -> list[str]:
    return list(dict.fromkeys([*node.fields.values(), *([then.key] if then else [])]))


def rows_of(text: Column, path: tuple[Node, ...], make) -> Column:
    """Array of ``make(positions, object)`` for every object at ``path`` of the record ``text``.

    ``positions`` maps the position column of each ``many`` node on the path to its value.
    """

    def level(parent: Column, i: int, positions: dict[str, Column]) -> Column:
        node, then = path[i], path[i + 1] if i + 1 < len(path) else None
        part = parent[node.key]

        def one(element: Column, here: dict[str, Column]) -> Column:
            keys = _keys(node, then)
            use = (lambda o: make(here, o)) if then is None else (lambda o: level(o, i + 1, here))
            return _let(_object(element, keys or ["_"]), use)

        if not node.many:
            single = one(part, positions)
            return F.array(single) if then is None else single
        column = position_column(node)
        elements = F.transform(_list(part), lambda e, k: one(e, {**positions, column: k.cast("int")}))
        return elements if then is None else F.flatten(F.filter(elements, lambda a: a.isNotNull()))

    return _let(_object(complete_json(text), [path[0].key]), lambda o: level(o, 0, {}))


def flatten_records(df: DataFrame, json_column: str, keys: list[str], spec: tuple[Node, ...], only: set[str] | None = None) -> dict[str, DataFrame]:
    """One flat table for each node of ``spec`` that has fields, or of those named in ``only``.

    Every table holds ``keys`` (the record's identity), the position of each list on the way down and the node's fields.
    A row is emitted for every object present, so a parent without children is still visible in the parent's own table.
    """
    tables: dict[str, DataFrame] = {}
    for root in spec:
        for path in root.walk():
            node = path[-1]
            if not node.fields or only is not None and table_name(path) not in only:
                continue
            positions = [position_column(n) for n in path if n.many]
            clash = set(keys) & {*positions, *node.fields}
            if clash:
                raise ValueError(f"key columns clash with generated columns: {sorted(clash)}")

            def make(here: dict[str, Column], obj: Column, node: Node = node) -> Column:
                row = F.struct(*[v.alias(k) for k, v in here.items()], *[obj[k].alias(c) for c, k in node.fields.items()])
                return F.when(obj.isNotNull(), row)

            rows = F.filter(rows_of(F.col(json_column), path, make), lambda r: r.isNotNull())
            tables[table_name(path)] = df.select(*keys, F.inline(rows))
    return tables


@dataclass(frozen=True)
class Leaf:
    """A value to list in the long form: the path to its object, its key, and the kind it is reported as."""

    kind: str
    path: tuple[Node, ...]
    key: str


@dataclass
class _Branch:
    """Leaves below one object, gathered so that the object is read once for all of them."""

    many: bool
    leaves: list[Leaf] = field(default_factory=list)
    below: dict[str, _Branch] = field(default_factory=dict)

    def add(self, path: tuple[Node, ...], leaf: Leaf) -> None:
        if not path:
            self.leaves.append(leaf)
            return
        self.below.setdefault(path[0].key, _Branch(path[0].many)).add(path[1:], leaf)

    def keys(self) -> list[str]:
        return list(dict.fromkeys([*(leaf.key for leaf in self.leaves), *self.below]))


def long_form(df: DataFrame, json_column: str, keys: list[str], leaves: list[Leaf], levels: Mapping[str, str]) -> DataFrame:
    """All non-null leaf values in one pass: keys, one position column per level, kind, value.

    ``levels`` maps each output position column to the node key it reports; a level that a leaf's path lacks is -1, and
    the leaf's own list position is ``child_pos``. Every object of the record is read once, whatever number of leaves lie below.
    """
    absent = F.lit(-1)
    row_type = "array<struct<" + "".join(f"{c}:int," for c in levels) + "child_kind:string,child_pos:int,child_value:string>>"
    nothing = F.array().cast(row_type)

    def rows(obj: Column, branch: _Branch, here: dict[str, Column], own: Column) -> Column:
        parts = [
            F.array(F.struct(*[here.get(k, absent).alias(c) for c, k in levels.items()], F.lit(leaf.kind).alias("child_kind"), own.alias("child_pos"), obj[leaf.key].alias("child_value"))) for leaf in branch.leaves
        ]
        for key, child in branch.below.items():
            parts.append(F.coalesce(below(obj[key], key, child, here), nothing))
        return F.concat(*parts)

    def below(part: Column, key: str, branch: _Branch, here: dict[str, Column]) -> Column:
        if not branch.many:
            return _let(_object(part, branch.keys()), lambda o: rows(o, branch, here, absent))

        def element(e: Column, k: Column) -> Column:
            at = k.cast("int")
            return _let(_object(e, branch.keys()), lambda o: rows(o, branch, {**here, key: at}, at))

        return F.flatten(F.transform(_list(part), element))

    top = _Branch(False)
    for leaf in leaves:
        top.add(leaf.path, leaf)
    found = _let(_object(complete_json(F.col(json_column)), top.keys()), lambda o: rows(o, top, {}, absent))
    return df.select(*keys, F.inline(F.filter(found, lambda r: r["child_value"].isNotNull())))
