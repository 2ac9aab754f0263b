"""The syntax tree of a query. Nodes are frozen, so equal expressions are equal keys: noise is drawn once for each distinct aggregate."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Node:
    def children(self) -> Iterator[Node]:
        for f in fields(self):
            yield from _nodes(getattr(self, f.name))

    def find(self, kind: type | tuple[type, ...]) -> Iterator[Node]:
        """Every node of a kind below and including this one, from the top."""
        if isinstance(self, kind):
            yield self
        for c in self.children():
            yield from c.find(kind)


def _nodes(x) -> Iterator[Node]:
    if isinstance(x, Node):
        yield x
    elif isinstance(x, tuple):
        for y in x:
            yield from _nodes(y)


@dataclass(frozen=True)
class Literal(Node):
    value: object  # int, float, str, bool or None


@dataclass(frozen=True)
class Column(Node):
    parts: tuple[str, ...]

    @property
    def name(self) -> str:
        return self.parts[-1]


@dataclass(frozen=True)
class Star(Node):
    table: tuple[str, ...] = ()


@dataclass(frozen=True)
class Call(Node):
    name: str  # upper case
    args: tuple[Node, ...] = ()
    distinct: bool = False


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class Unary(Node):
    op: str  # "-" or "NOT"
    arg: Node


@dataclass(frozen=True)
class Between(Node):
    arg: Node
    low: Node
    high: Node
    negated: bool = False


@dataclass(frozen=True)
class In(Node):
    arg: Node
    options: tuple[Node, ...]
    negated: bool = False


@dataclass(frozen=True)
class Is(Node):
    arg: Node
    what: str  # NULL, TRUE or FALSE
    negated: bool = False


@dataclass(frozen=True)
class Case(Node):
    base: Node | None
    whens: tuple[tuple[Node, Node], ...]
    otherwise: Node | None


@dataclass(frozen=True)
class Cast(Node):
    arg: Node
    kind: str
    length: int | None = None


@dataclass(frozen=True)
class Extract(Node):
    part: str
    arg: Node


@dataclass(frozen=True)
class Ranking(Node):
    name: str
    partition: Node | None
    order: tuple[tuple[Node, bool], ...]  # (expression, descending)


@dataclass(frozen=True)
class Scalar(Node):
    query: Select


@dataclass(frozen=True)
class Table(Node):
    parts: tuple[str, ...]
    alias: str | None = None


@dataclass(frozen=True)
class Derived(Node):
    query: Select
    alias: str | None = None


@dataclass(frozen=True)
class Join(Node):
    left: Node
    right: Node
    kind: str  # INNER, CROSS, LEFT, RIGHT, FULL, LEFT SEMI, LEFT ANTI
    on: Node | None = None
    using: tuple[str, ...] = ()


@dataclass(frozen=True)
class Item(Node):
    expr: Node
    alias: str | None = None

    @property
    def name(self) -> str | None:
        return self.alias or (self.expr.name if isinstance(self.expr, Column) else None)


@dataclass(frozen=True)
class Select(Node):
    items: tuple[Item, ...]
    relations: tuple[Node, ...] = ()
    where: Node | None = None
    group: tuple[Node, ...] = ()
    having: Node | None = None
    order: tuple[tuple[Node, bool], ...] = ()
    limit: int | None = None
    distinct: bool = False


AGGREGATES = {"COUNT", "SUM", "AVG", "VAR", "VARIANCE", "STD", "STDDEV", "STDEV", "MIN", "MAX", "PERCENTILE_DISC", "PERCENTILE_CONT"}


def is_aggregate(x: Node) -> bool:
    return isinstance(x, Call) and x.name in AGGREGATES
