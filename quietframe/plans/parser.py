"""Text to syntax tree: a tokenizer and a recursive-descent parser for the SQL-92 subset that the engine takes.

Names may be quoted with double quotes, brackets or backticks, and hold any letters. Arithmetic has the standard precedence.
"""

from __future__ import annotations

import re

from quietframe.plans.ast import Between, Binary, Call, Case, Cast, Column, Derived, Extract, In, Is, Item, Join, Literal, Node, Ranking, Scalar, Select, Star, Table, Unary

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
      | (?P<number>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)
      | (?P<string>'(?:[^'\\]|\\.|'')*')
      | (?P<quoted>"(?:[^"]|"")+"|\[[^\]]+\]|`(?:[^`]|``)+`)
      | (?P<name>[^\W\d]\w*)
      | (?P<op><=>|<>|!=|!>|!<|==|<=|>=|[-+*/%=<>(),.;])""",
    re.X | re.S,
)
_RESERVED = set("SELECT FROM WHERE GROUP BY HAVING ORDER LIMIT TOP AS ON USING JOIN INNER CROSS LEFT RIGHT FULL OUTER SEMI ANTI AND OR NOT IN IS NULL BETWEEN CASE WHEN THEN ELSE END DISTINCT ALL TRUE FALSE CAST UNION INTERSECT EXCEPT OVER ASC DESC".split())
_RANKINGS = {"ROW_NUMBER", "RANK", "DENSE_RANK"}
_PARTS = {"YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND", "MICROSECOND", "WEEKDAY"}
_CASTS = {"INTEGER", "INT", "FLOAT", "DOUBLE", "BOOLEAN", "TIMESTAMP", "DATE", "TIME", "VARCHAR", "NVARCHAR", "CHAR", "NCHAR"}
_BARE = {"CURRENT_DATE", "CURRENT_TIME", "CURRENT_TIMESTAMP"}


class ParseError(ValueError):
    """The text isn't a query that the engine takes."""


def tokenize(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ParseError(f"unexpected text at {at}: {text[at : at + 20]!r}")
        at = m.end()
        if m.lastgroup != "space":
            out.append((m.lastgroup, m.group()))
    return [*out, ("end", "")]


class Parser:
    def __init__(self, text: str):
        self.tokens, self.at = tokenize(text), 0

    # -- tokens

    def word(self, ahead: int = 0) -> str:
        kind, text = self.tokens[min(self.at + ahead, len(self.tokens) - 1)]
        return text.upper() if kind in ("name", "op") else ""

    def take(self, *words: str) -> bool:
        if all(self.word(i) == w for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise ParseError(f"expected {' '.join(words)} before {self.tokens[self.at][1] or 'the end'!r}")

    def identifier(self) -> str:
        kind, text = self.tokens[self.at]
        if kind == "quoted":
            self.at += 1
            return text[1:-1].replace(text[-1] * 2, text[-1])
        if kind == "name" and text.upper() not in _RESERVED:
            self.at += 1
            return text
        raise ParseError(f"expected a name before {text or 'the end'!r}")

    def integer(self) -> int:
        kind, text = self.tokens[self.at]
        if kind != "number" or not text.isdigit():
            raise ParseError(f"expected a whole number before {text!r}")
        self.at += 1
        return int(text)

    def alias(self) -> str | None:
        if self.take("AS"):
            return self.identifier()
        kind, text = self.tokens[self.at]
        return self.identifier() if kind == "quoted" or kind == "name" and text.upper() not in _RESERVED else None

    # -- queries

    def batch(self) -> list[Select]:
        out = [self.select()]
        while self.take(";"):
            if self.tokens[self.at][0] != "end":
                out.append(self.select())
        if self.tokens[self.at][0] != "end":
            raise ParseError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def select(self, inner: bool = False) -> Select:
        self.need("SELECT")
        distinct, top = False, None
        if self.take("TOP"):
            top = self.integer()
        if self.take("DISTINCT"):
            distinct = True
        else:
            self.take("ALL")
        if top is None and self.take("TOP"):
            top = self.integer()
        items = [self.item()]
        while self.take(","):
            items.append(self.item())
        relations = []
        if self.take("FROM"):
            relations.append(self.joined())
            while self.take(","):
                relations.append(self.joined())
        where = self.expr() if self.take("WHERE") else None
        group: list[Node] = []
        if self.take("GROUP", "BY"):
            group.append(self.expr())
            while self.take(","):
                group.append(self.expr())
        having = self.expr() if self.take("HAVING") else None
        order = self.ordering() if self.take("ORDER", "BY") else ()
        limit = None
        if self.take("LIMIT"):
            if inner:
                raise ParseError("LIMIT isn't allowed in a subquery")
            if top is not None:
                raise ParseError("TOP and LIMIT exclude each other")
            limit = self.integer()
        return Select(tuple(items), tuple(relations), where, tuple(group), having, order, top if limit is None else limit, distinct)

    def ordering(self) -> tuple[tuple[Node, bool], ...]:
        out = []
        while True:
            e = self.expr()
            out.append((e, True) if self.take("DESC") else (e, bool(self.take("ASC")) and False))
            if not self.take(","):
                return tuple(out)

    def item(self) -> Item:
        if self.take("*"):
            return Item(Star())
        mark, parts = self.at, []
        try:
            parts.append(self.identifier())
            while self.take("."):
                if self.take("*"):
                    return Item(Star(tuple(parts)))
                parts.append(self.identifier())
        except ParseError:
            pass
        self.at = mark
        return Item(self.expr(), self.alias())

    def joined(self) -> Node:
        left = self.relation()
        while True:
            if self.take("CROSS", "JOIN"):
                left = Join(left, self.relation(), "CROSS")
                continue
            kind = None
            for words, name in ((("INNER",), "INNER"), (("LEFT", "SEMI"), "LEFT SEMI"), (("LEFT", "ANTI"), "LEFT ANTI"), (("SEMI",), "LEFT SEMI"), (("ANTI",), "LEFT ANTI"), (("LEFT", "OUTER"), "LEFT"), (("LEFT",), "LEFT"), (("RIGHT", "OUTER"), "RIGHT"), (("RIGHT",), "RIGHT"), (("FULL", "OUTER"), "FULL"), (("FULL",), "FULL"), ((), "INNER")):
                if all(self.word(i) == w for i, w in enumerate(words)) and self.word(len(words)) == "JOIN":
                    self.at += len(words) + 1
                    kind = name
                    break
            if kind is None:
                return left
            right = self.relation()
            if self.take("USING"):
                self.need("(")
                using = [self.identifier()]
                while self.take(","):
                    using.append(self.identifier())
                self.need(")")
                left = Join(left, right, kind, None, tuple(using))
            elif self.take("ON"):
                left = Join(left, right, kind, self.expr())
            else:
                raise ParseError("a join needs ON or USING")

    def relation(self) -> Node:
        if self.take("("):
            if self.word() == "SELECT":
                q = self.select(inner=True)
                self.need(")")
                return Derived(q, self.alias())
            r = self.joined()
            self.need(")")
            return r
        parts = [self.identifier()]
        while self.take("."):
            parts.append(self.identifier())
        if len(parts) > 3:
            raise ParseError("a table name has at most three parts")
        return Table(tuple(parts), self.alias())

    # -- expressions

    def expr(self) -> Node:
        left = self.conjunction()
        while self.take("OR"):
            left = Binary("OR", left, self.conjunction())
        return left

    def conjunction(self) -> Node:
        left = self.negation()
        while self.take("AND"):
            left = Binary("AND", left, self.negation())
        return left

    def negation(self) -> Node:
        return Unary("NOT", self.negation()) if self.take("NOT") else self.comparison()

    def comparison(self) -> Node:
        left = self.sum()
        while True:
            if self.take("IS"):
                negated = self.take("NOT")
                for what in ("NULL", "TRUE", "FALSE"):
                    if self.take(what):
                        left = Is(left, what, negated)
                        break
                else:
                    raise ParseError("IS needs NULL, TRUE or FALSE")
                continue
            mark = self.at
            negated = self.take("NOT")
            if self.take("BETWEEN"):
                low = self.sum()
                self.need("AND")
                left = Between(left, low, self.sum(), negated)
                continue
            if self.take("IN"):
                self.need("(")
                options = [self.expr()]
                while self.take(","):
                    options.append(self.expr())
                self.need(")")
                left = In(left, tuple(options), negated)
                continue
            self.at = mark
            for op in ("<=>", "<>", "!=", "!>", "!<", "==", "<=", ">=", "=", "<", ">"):
                if self.take(op):
                    left = Binary({"!=": "<>", "==": "=", "!>": "<=", "!<": ">="}.get(op, op), left, self.sum())
                    break
            else:
                return left

    def sum(self) -> Node:
        left = self.product()
        while self.word() in ("+", "-"):
            op = self.word()
            self.at += 1
            left = Binary(op, left, self.product())
        return left

    def product(self) -> Node:
        left = self.signed()
        while self.word() in ("*", "/", "%"):
            op = self.word()
            self.at += 1
            left = Binary(op, left, self.signed())
        return left

    def signed(self) -> Node:
        if self.take("-"):
            x = self.signed()
            return Literal(-x.value) if isinstance(x, Literal) and isinstance(x.value, int | float) and not isinstance(x.value, bool) else Unary("-", x)
        self.take("+")
        return self.primary()

    def primary(self) -> Node:
        kind, text = self.tokens[self.at]
        if kind == "number":
            self.at += 1
            return Literal(int(text) if text.isdigit() else float(text))
        if kind == "string":
            self.at += 1
            return Literal(re.sub(r"\\(.)", r"\1", text[1:-1].replace("''", "'"), flags=re.S))
        for word, value in (("TRUE", True), ("FALSE", False), ("NULL", None)):
            if self.take(word):
                return Literal(value)
        if self.take("("):
            if self.word() == "SELECT":
                q = self.select(inner=True)
                self.need(")")
                return Scalar(q)
            x = self.expr()
            self.need(")")
            return x
        if self.take("CASE"):
            base = None if self.word() == "WHEN" else self.expr()
            whens = []
            while self.take("WHEN"):
                test = self.expr()
                self.need("THEN")
                whens.append((test, self.expr()))
            if not whens:
                raise ParseError("CASE needs WHEN")
            otherwise = self.expr() if self.take("ELSE") else None
            self.need("END")
            return Case(base, tuple(whens), otherwise)
        if self.take("CAST"):
            self.need("(")
            x = self.expr()
            self.need("AS")
            kind = self.identifier().upper()
            if kind not in _CASTS:
                raise ParseError(f"can't cast to {kind}")
            length = None
            if self.take("("):
                length = self.integer()
                self.need(")")
            self.need(")")
            return Cast(x, kind, length)
        name = self.word()
        if kind == "name" and name in _BARE and self.word(1) != "(":
            self.at += 1
            return Call(name)
        if kind == "name" and self.word(1) == "(" and (name not in _RESERVED or name in ("LEFT", "RIGHT")):
            self.at += 2
            return self.call(name)
        parts = [self.identifier()]
        while self.take("."):
            parts.append(self.identifier())
        return Column(tuple(parts))

    def call(self, name: str) -> Node:
        if name in _RANKINGS:
            self.need(")")
            self.need("OVER")
            self.need("(")
            partition = self.expr() if self.take("PARTITION", "BY") else None
            order = self.ordering() if self.take("ORDER", "BY") else ()
            self.need(")")
            return Ranking(name, partition, order)
        if name == "EXTRACT":
            part = self.identifier().upper()
            if part not in _PARTS:
                raise ParseError(f"can't extract {part}")
            self.need("FROM")
            x = self.expr()
            self.need(")")
            return Extract(part, x)
        if name == "POSITION":
            a = self.sum()
            self.need("IN")
            b = self.expr()
            self.need(")")
            return Call(name, (a, b))
        if name == "SUBSTRING":
            args = [self.expr()]
            if self.take("FROM"):
                args.append(self.expr())
                if self.take("FOR"):
                    args.append(self.expr())
            else:
                while self.take(","):
                    args.append(self.expr())
            self.need(")")
            return Call(name, tuple(args))
        distinct = self.take("DISTINCT")
        if not distinct:
            self.take("ALL")
        args = []
        if self.take("*"):
            args.append(Star())
        elif self.word() != ")":
            args.append(self.expr())
            while self.take(","):
                args.append(self.expr())
        self.need(")")
        return Call(name, tuple(args), distinct)


def parse(text: str) -> Select:
    """One query."""
    queries = Parser(text).batch()
    if len(queries) != 1:
        raise ParseError("one query is expected")
    return queries[0]


def parse_batch(text: str) -> list[Select]:
    """Queries that semicolons part."""
    return Parser(text).batch()


def parse_expression(text: str) -> Node:
    p = Parser(text)
    x = p.expr()
    if p.tokens[p.at][0] != "end":
        raise ParseError(f"unexpected {p.tokens[p.at][1]!r}")
    return x
