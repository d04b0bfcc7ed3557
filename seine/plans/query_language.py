"""The search query language: text to tokens, tokens to a tree.

Atoms side by side are all required, ``or`` separates alternatives, ``-`` negates an atom or a group, parentheses group. A bare
atom matches content or path and is a regular expression, or plain text if it has no pattern character. Fields: ``repo file
content lang sym case archived fork public context rev`` with their short forms ``r f c l``. ``sym`` needs a symbol table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class InvalidQuery(ValueError):
    """The query text breaks a rule of the language."""


@dataclass(frozen=True)
class All:
    parts: tuple


@dataclass(frozen=True)
class Any:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class Const:
    value: bool


@dataclass(frozen=True)
class Text:
    pattern: str
    where: str = "any"  # any, content, file
    regex: bool = False


@dataclass(frozen=True)
class Repo:
    pattern: str


@dataclass(frozen=True)
class Lang:
    name: str


@dataclass(frozen=True)
class Symbol:
    pattern: str


@dataclass(frozen=True)
class Flag:
    name: str  # archived, fork, public
    value: bool


@dataclass(frozen=True)
class Parsed:
    tree: object
    contexts: tuple[str, ...] = ()
    revision: str = ""
    case: str = "auto"
    texts: tuple[Text, ...] = field(default=())


_SHORT = {"r": "repo", "f": "file", "c": "content", "l": "lang", "language": "lang"}
_FIELDS = {"repo", "file", "content", "lang", "sym", "case", "archived", "fork", "public"}
_REVISION = re.compile(r"[A-Za-z0-9][A-Za-z0-9._/-]*\Z")


def tokenize(raw: str) -> list[str]:
    """Cut at white space; a backslash keeps the next character, a quoted span stays whole. Bytes of a token are kept."""
    tokens, current, quoted, i = [], "", False, 0
    while i < len(raw):
        c = raw[i]
        if c == "\\" and i + 1 < len(raw):
            current += raw[i : i + 2]
            i += 2
            continue
        if c == '"':
            quoted = not quoted
        if not quoted and c in " \t\r\n":
            if current:
                tokens.append(current)
            current = ""
        else:
            current += c
        i += 1
    return [*tokens, current] if current else tokens


def _scopes(tokens: list[str]) -> tuple[list[str], list[str], list[str]]:
    """Take ``context:`` and ``rev:`` tokens out; they may be neither negated nor grouped."""
    contexts, revisions, rest = [], [], []
    for t in tokens:
        bare = t.lstrip("-(")
        name, colon, value = bare.partition(":")
        if colon and name in ("context", "rev"):
            if bare != t or (value.endswith(")") and not value.endswith("\\)")):
                raise InvalidQuery(f"{name}: can be neither negated nor grouped")
            if not value:
                raise InvalidQuery(f"{name}: needs a value")
            (contexts if name == "context" else revisions).append(value)
        else:
            rest.append(t)
    return contexts, revisions, rest


def _lex(tokens: list[str]) -> list[str]:
    """Detach grouping parentheses and negation signs from the atoms."""
    out = []
    for t in tokens:
        while t and t[0] in "-(" and len(t) > 1:
            out.append(t[0])
            t = t[1:]
        closing = 0
        while t.endswith(")") and not t.endswith("\\)") and t.count("(") - t.count("\\(") < t.count(")") - t.count("\\)"):
            t, closing = t[:-1], closing + 1
        if t:
            out.append(t)
        out += [")"] * closing
    return out


def _unquote(value: str) -> tuple[str, bool]:
    """The value without quotes, and whether a quoted span makes it literal."""
    if len(value) >= 2 and value[0] == value[-1] == '"':
        return value[1:-1].replace('\\"', '"').replace("\\\\", "\\"), True
    return value, False


def _text(value: str, where: str) -> Text:
    literal, quoted = _unquote(value)
    if quoted:
        return Text(literal, where)
    if re.search(r"[.*+?^$|()\[\]{}\\]", literal):
        try:
            re.compile(literal)
        except re.error as e:
            raise InvalidQuery(f"bad pattern {literal!r}: {e}") from None
        return Text(literal, where, True)
    return Text(literal, where)


def _yes_no(name: str, value: str) -> bool:
    if value not in ("yes", "no", "only"):
        raise InvalidQuery(f"{name}: takes yes or no")
    return value != "no"


class _Parser:
    def __init__(self, tokens: list[str]) -> None:
        self.tokens, self.at, self.case, self.texts = tokens, 0, "auto", []

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1]

    def alternatives(self, negated: bool = False):
        options = [self.sequence(negated)]
        while self.peek() == "or":
            self.take()
            options.append(self.sequence(negated))
        return options[0] if len(options) == 1 else Any(tuple(options))

    def sequence(self, negated: bool):
        parts = []
        while self.peek() not in (None, ")", "or"):
            part = self.atom(negated)
            if part is not None:
                parts.append(part)
        if not parts:
            return Const(True)
        return parts[0] if len(parts) == 1 else All(tuple(parts))

    def atom(self, negated: bool):
        t = self.take()
        if t == "-":
            if self.peek() is None:
                raise InvalidQuery("nothing to negate")
            part = self.atom(not negated)
            if part is None:
                raise InvalidQuery("case: cannot be negated")
            return Not(part)
        if t == "(":
            inner = self.alternatives(negated)
            if self.peek() != ")":
                raise InvalidQuery("missing )")
            self.take()
            return inner
        name, colon, value = t.partition(":")
        name = _SHORT.get(name, name)
        if not colon or name not in _FIELDS or t.startswith('"'):
            return self.keep(_text(t, "any"), negated)
        if not value:
            raise InvalidQuery(f"{name}: needs a value")
        if name == "case":
            if value not in ("yes", "no", "auto"):
                raise InvalidQuery("case: takes yes, no or auto")
            self.case = value
            return None
        if name in ("archived", "fork", "public"):
            return Flag(name, _yes_no(name, value))
        if name == "repo":
            return Repo(_unquote(value)[0])
        if name == "lang":
            return Lang(_unquote(value)[0].lower())
        if name == "sym":
            return Symbol(_unquote(value)[0])
        return self.keep(_text(value, name), negated)

    def keep(self, text: Text, negated: bool) -> Text:
        if not negated:
            self.texts.append(text)
        return text


def simplify(node):
    """Fold constants and nested groups."""
    if isinstance(node, Not):
        inner = simplify(node.part)
        if isinstance(inner, Const):
            return Const(not inner.value)
        return inner.part if isinstance(inner, Not) else Not(inner)
    if isinstance(node, (All, Any)):
        kind, neutral = type(node), isinstance(node, All)
        parts = []
        for p in map(simplify, node.parts):
            if isinstance(p, Const):
                if p.value != neutral:
                    return Const(not neutral)
            else:
                parts += p.parts if isinstance(p, kind) else [p]
        return Const(neutral) if not parts else parts[0] if len(parts) == 1 else kind(tuple(parts))
    return node


def parse(raw: str) -> Parsed:
    """Parse a query; raises :class:`InvalidQuery`."""
    contexts, revisions, rest = _scopes(tokenize(raw))
    if len(revisions) > 1:
        raise InvalidQuery("only one rev: is allowed")
    if revisions and not _REVISION.match(revisions[0]):
        raise InvalidQuery(f"bad revision {revisions[0]!r}")
    if (contexts or revisions) and not rest:
        raise InvalidQuery("context: and rev: need search terms beside them")
    parser = _Parser(_lex(rest))
    tree = parser.alternatives()
    if parser.peek() is not None:
        raise InvalidQuery(f"unexpected {parser.peek()}")
    return Parsed(simplify(tree), tuple(contexts), revisions[0] if revisions else "", parser.case, tuple(parser.texts))
