"""Syntax tree to Spark SQL: one lowering for filters, exact aggregates and the expressions over noisy results. Catalyst does the rest.

Meanings kept on purpose: division by zero is 0; % has the divisor's sign; ROUND is half-even; TRUNC is floor; CHOOSE out of range is NULL;
VAR and STDDEV are of the population; casts that fail are NULL; TRUE and FALSE tests take the usual words.
"""

from __future__ import annotations

from collections.abc import Callable

from quietframe.plans.ast import Between, Binary, Call, Case, Cast, Column, Derived, Extract, In, Is, Join, Literal, Node, Ranking, Scalar, Select, Star, Table, Unary

_SAME = {"ABS", "CEIL", "CEILING", "FLOOR", "SQRT", "EXP", "LN", "LOG10", "LOG2", "SIN", "COS", "TAN", "ASIN", "ACOS", "ATAN", "ATANH", "DEGREES", "UPPER", "LOWER", "CHAR_LENGTH", "CONCAT", "COALESCE", "COUNT", "SUM", "AVG", "MIN", "MAX", "PI"}
_RENAMED = {"LOG": "ln", "SIGN": "signum", "POWER": "pow", "VAR": "var_pop", "VARIANCE": "var_pop", "STD": "stddev_pop", "STDDEV": "stddev_pop", "STDEV": "stddev_pop", "RAND": "rand", "RANDOM": "rand", "NEWID": "uuid", "CURRENT_DATE": "current_date", "CURRENT_TIMESTAMP": "current_timestamp"}
_CAST = {"INTEGER": "bigint", "INT": "bigint", "FLOAT": "double", "DOUBLE": "double", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp", "DATE": "date", "TIME": "string", "VARCHAR": "string", "NVARCHAR": "string", "CHAR": "string", "NCHAR": "string"}
#: Words that IS TRUE and IS FALSE take.
TRUE_WORDS, FALSE_WORDS = ("true", "t", "y", "yes", "on", "1"), ("false", "f", "n", "no", "off", "0")
ARITY = {"SQUARE": (1, 1), "ROUND": (1, 2), "TRUNC": (1, 2), "TRUNCATE": (1, 2), "IIF": (3, 3), "CHOOSE": (2, 99), "TRIM": (1, 1), "POSITION": (2, 2), "SUBSTRING": (2, 3), "DAYNAME": (1, 1), "CURRENT_TIME": (0, 0), "PERCENTILE_CONT": (2, 2), "PERCENTILE_DISC": (2, 2)}


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value!r}D" if isinstance(value, float) else f"{value}L" if abs(value) >= 2**31 else str(value)


def known(name: str) -> bool:
    return name in _SAME or name in _RENAMED or name in ARITY


def render(x: Node, name: Callable[[Node], str | None] = lambda _: None) -> str:
    """Spark SQL of an expression. name: gives the text of a node that stands for something else, such as a computed column."""
    if (own := name(x)) is not None:
        return own
    r = lambda y: render(y, name)
    match x:
        case Literal(v):
            return literal(v)
        case Column(parts):
            return ".".join(map(quote, parts))
        case Star(t):
            return ".".join([*map(quote, t), "*"])
        case Unary("NOT", a):
            return f"(NOT {r(a)})"
        case Unary(_, a):
            return f"(- {r(a)})"
        case Binary("/", a, b):
            return f"(CASE WHEN {r(b)} = 0 THEN 0D ELSE CAST({r(a)} AS double) / {r(b)} END)"
        case Binary("%", a, b):
            d = f"nullif({r(b)}, 0)"
            return f"((({r(a)}) % {d} + {d}) % {d})"
        case Binary(op, a, b):
            return f"({r(a)} {op} {r(b)})"
        case Between(a, lo, hi, n):
            return f"({r(a)} {'NOT ' if n else ''}BETWEEN {r(lo)} AND {r(hi)})"
        case In(a, options, n):
            return f"({r(a)} {'NOT ' if n else ''}IN ({', '.join(map(r, options))}))"
        case Is(a, "NULL", n):
            return f"({r(a)} IS {'NOT ' if n else ''}NULL)"
        case Is(a, what, n):
            words = ", ".join(map(literal, TRUE_WORDS if what == "TRUE" else FALSE_WORDS))
            test = f"coalesce(lower(CAST({r(a)} AS string)) IN ({words}), FALSE)"
            return f"(NOT {test})" if n else test
        case Case(base, whens, other):
            text = " ".join(f"WHEN {r(a)} THEN {r(b)}" for a, b in whens)
            return f"(CASE {r(base) + ' ' if base else ''}{text}{f' ELSE {r(other)}' if other else ''} END)"
        case Cast(a, kind, length):
            text = f"try_cast({r(a)} AS {_CAST[kind]})"
            return f"substring({text}, 1, {length})" if length is not None and _CAST[kind] == "string" and kind != "TIME" else text
        case Extract(part, a):
            if part == "MICROSECOND":
                return f"CAST(unix_micros(CAST({r(a)} AS timestamp)) % 1000000 AS int)"
            return f"{part.lower()}({r(a)})"
        case Ranking(fn, partition, order):
            by = f"PARTITION BY {r(partition)} " if partition else ""
            return f"{fn.lower()}() OVER ({by}ORDER BY {', '.join(r(e) + (' DESC' if d else '') for e, d in order)})"
        case Scalar(q):
            return f"({render_select(q, name)})"
        case Call():
            return _call(x, r)
    raise ValueError(f"can't lower {x}")


def _call(x: Call, r: Callable[[Node], str]) -> str:
    a = [r(y) for y in x.args]
    low, high = ARITY.get(x.name, (0, 99))
    if not low <= len(a) <= high:
        raise ValueError(f"{x.name} takes {low} to {high} arguments")
    match x.name:
        case "SQUARE":
            return f"pow({a[0]}, 2)"
        case "ROUND":
            return f"bround({', '.join(a)})"
        case "TRUNC" | "TRUNCATE":
            return f"CAST(floor({a[0]}) AS double)" if len(a) == 1 else f"(floor({a[0]} * pow(10, {a[1]})) / pow(10, {a[1]}))"
        case "IIF":
            return f"if({', '.join(a)})"
        case "CHOOSE":
            return f"(CASE WHEN {a[0]} BETWEEN 1 AND {len(a) - 1} THEN element_at(array({', '.join(a[1:])}), {a[0]}) END)"
        case "TRIM":
            return f"regexp_replace({a[0]}, '^\\\\s+|\\\\s+$', '')"
        case "POSITION":
            return f"position({a[0]}, {a[1]})"
        case "SUBSTRING":
            at = f"CASE WHEN {a[1]} = 0 THEN 1 ELSE {a[1]} END"
            return f"(CASE WHEN {a[2]} >= 1 THEN substring({a[0]}, {at}, {a[2]}) END)" if len(a) == 3 else f"substring({a[0]}, {at})"
        case "DAYNAME":
            return f"date_format({a[0]}, 'EEEE')"
        case "CURRENT_TIME":
            return "date_format(current_timestamp(), 'HH:mm:ss')"
        case "PERCENTILE_CONT" | "PERCENTILE_DISC":
            return f"{x.name.lower()}({a[1]}) WITHIN GROUP (ORDER BY {a[0]})"
    fn = x.name.lower() if x.name in _SAME else _RENAMED.get(x.name)
    if fn is None:
        raise ValueError(f"unknown function {x.name}")
    return f"{fn}({'DISTINCT ' if x.distinct else ''}{', '.join(a)})"


def render_relation(x: Node, table: Callable[[Table], str]) -> str:
    match x:
        case Table():
            return table(x) + (f" AS {quote(x.alias)}" if x.alias else "")
        case Derived(q, alias):
            return f"({render_select(q, table=table)})" + (f" AS {quote(alias)}" if alias else "")
        case Join(a, b, kind, on, using):
            tail = f" USING ({', '.join(map(quote, using))})" if using else f" ON {render(on)}" if on is not None else ""
            right = render_relation(b, table)
            return f"{render_relation(a, table)} {kind} JOIN {f'({right})' if isinstance(b, Join) else right}{tail}"
    raise ValueError(f"can't lower {x}")


def render_select(q: Select, name: Callable[[Node], str | None] = lambda _: None, table: Callable[[Table], str] = lambda t: ".".join(map(quote, t.parts))) -> str:
    items = ", ".join(render(i.expr, name) + (f" AS {quote(i.alias)}" if i.alias else "") for i in q.items)
    text = f"SELECT {'DISTINCT ' if q.distinct else ''}{items}"
    if q.relations:
        text += " FROM " + ", ".join(render_relation(r, table) for r in q.relations)
    if q.where is not None:
        text += f" WHERE {render(q.where, name)}"
    if q.group:
        text += f" GROUP BY {', '.join(render(g, name) for g in q.group)}"
    if q.having is not None:
        text += f" HAVING {render(q.having, name)}"
    if q.order:
        text += f" ORDER BY {', '.join(render(e, name) + (' DESC' if d else '') for e, d in q.order)}"
    return text + (f" LIMIT {q.limit}" if q.limit is not None else "")
