"""What is public about private tables: columns with types and bounds, the private key, and the rules of release. From dicts or YAML."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from pathlib import Path

TYPES = {"int", "float", "string", "boolean", "datetime"}
NUMERIC = {"int", "float"}


@dataclass
class ColumnInfo:
    name: str
    type: str
    private_id: bool = False
    lower: float | None = None
    upper: float | None = None
    nullable: bool = True
    missing_value: object = None
    sensitivity: float | None = None
    cardinality: int = 0

    def __post_init__(self) -> None:
        if self.type not in TYPES | {"unknown"}:
            raise ValueError(f"column {self.name}: unknown type {self.type}")
        if self.lower is not None and self.upper is not None and self.lower > self.upper:
            raise ValueError(f"column {self.name}: lower bound over upper bound")

    @property
    def bounded(self) -> bool:
        return self.lower is not None and self.upper is not None

    @property
    def range_sensitivity(self) -> float | None:
        """How much one row can change a sum."""
        if self.type == "boolean":
            return 1
        if self.sensitivity is not None:
            return self.sensitivity
        return max(abs(self.lower), abs(self.upper)) if self.bounded else None


@dataclass
class TableInfo:
    schema: str
    name: str
    columns: dict[str, ColumnInfo] = field(default_factory=dict)
    rows: int = 0
    rows_exact: int | None = None
    row_privacy: bool = False
    max_ids: int = 1
    sample_max_ids: bool = True
    censor_dims: bool = True
    clamp_counts: bool = False
    clamp_columns: bool = True
    use_dpsu: bool = False

    def __post_init__(self) -> None:
        if self.max_ids < 1:
            raise ValueError("max_ids is at least 1")
        for c in self.columns.values():
            if self.clamp_columns and c.type in NUMERIC and c.sensitivity is not None and not c.bounded:
                raise ValueError(f"column {c.name} has a sensitivity but no bounds, and clamp_columns is on")

    def find(self, name: str, quoted: bool = False) -> ColumnInfo | None:
        if name in self.columns:
            return self.columns[name]
        return None if quoted else next((c for k, c in self.columns.items() if k.lower() == name.lower()), None)

    @property
    def keys(self) -> list[ColumnInfo]:
        return [c for c in self.columns.values() if c.private_id]


_OPTIONS = ("rows", "rows_exact", "row_privacy", "max_ids", "sample_max_ids", "censor_dims", "clamp_counts", "clamp_columns", "use_dpsu")
_COLUMN_OPTIONS = ("private_id", "lower", "upper", "nullable", "missing_value", "sensitivity", "cardinality")


class Metadata:
    """Tables by schema and name. A blank schema or database in a query matches any."""

    def __init__(self, tables: list[TableInfo], name: str = "", engine: str | None = None):
        self.tables, self.name, self.engine = tables, name, engine

    @classmethod
    def from_dict(cls, d: dict) -> Metadata:
        """{collection: {schema: {table: {option or column}}}}, with "engine" beside the collection."""
        d = dict(d)
        engine = d.pop("engine", None)
        if len(d) != 1:
            raise ValueError("metadata has one collection")
        (name, schemas), tables = next(iter(d.items())), []
        for schema, named in schemas.items():
            for table, body in named.items():
                columns = {str(k): ColumnInfo(str(k), v["type"], **{o: v[o] for o in _COLUMN_OPTIONS if o in v}) for k, v in body.items() if k not in _OPTIONS}
                tables.append(TableInfo(str(schema), str(table), columns, **{o: body[o] for o in _OPTIONS if o in body}))
        return cls(tables, str(name), engine)

    @classmethod
    def from_file(cls, path: str) -> Metadata:
        import yaml

        return cls.from_dict(yaml.safe_load(Path(path).read_text()))

    @classmethod
    def of(cls, x: Metadata | dict | str) -> Metadata:
        return x if isinstance(x, Metadata) else cls.from_dict(x) if isinstance(x, dict) else cls.from_file(x)

    def to_dict(self) -> dict:
        schemas: dict = {}
        for t in self.tables:
            body: dict = {o: getattr(t, o) for o in _OPTIONS if getattr(t, o) is not None}
            for c in t.columns.values():
                body[c.name] = {k: v for k, v in asdict(c).items() if k != "name" and v is not None}
            schemas.setdefault(t.schema, {})[t.name] = body
        return {self.name or "": schemas} | ({"engine": self.engine} if self.engine else {})

    def to_file(self, path: str) -> None:
        import yaml

        Path(path).write_text(yaml.safe_dump(self.to_dict(), sort_keys=False))

    def find(self, parts: tuple[str, ...]) -> TableInfo:
        """The table that a name of one to three parts means; exactly one must fit."""
        want = [p.lower() for p in parts]
        found = [t for t in self.tables if [self.name.lower(), t.schema.lower(), t.name.lower()][-len(want) :] == want or (len(want) == 3 and not want[0] and [t.schema.lower(), t.name.lower()] == want[1:])]
        if len(found) != 1:
            raise ValueError(f"{'.'.join(parts)} fits {len(found)} tables")
        return found[0]
