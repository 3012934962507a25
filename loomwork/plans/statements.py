"""The dialect's statements as data, and their parser.

Keywords are in either case, names are case-sensitive. AND binds tighter than
OR. A statement has to end with its text (one semicolon may follow).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..errors import SyntaxFailure
from ..types import FLOAT, INT, TEXT

Literal = int | float | str | None


@dataclass(frozen=True)
class Compare:
    column: str
    op: str
    value: Literal


@dataclass(frozen=True)
class IsNull:
    column: str
    negated: bool


@dataclass(frozen=True)
class Both:
    parts: tuple


@dataclass(frozen=True)
class Either:
    parts: tuple


@dataclass(frozen=True)
class NewColumn:
    name: str
    kind: str
    primary_key: bool = False


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[NewColumn, ...]


@dataclass(frozen=True)
class Insert:
    table: str
    values: tuple[Literal, ...]


@dataclass(frozen=True)
class Select:
    table: str
    columns: tuple[str, ...] | None = None  # None: all
    where: object = None
    order: tuple[str, bool] | None = None  # column, descending
    limit: int | None = None


@dataclass(frozen=True)
class Nearest:
    """SELECT ... ORDER BY column <metric> [numbers] LIMIT k, over a vector column."""

    table: str
    columns: tuple[str, ...] | None
    where: object
    vector: str
    metric: str
    query: tuple[float, ...]
    limit: int


@dataclass(frozen=True)
class Update:
    table: str
    changes: dict[str, Literal] = field(hash=False)
    where: object = None


@dataclass(frozen=True)
class Delete:
    table: str
    where: object = None


@dataclass(frozen=True)
class Control:
    """BEGIN, COMMIT or ROLLBACK."""

    word: str


KEYWORDS = {
    "SELECT", "FROM", "WHERE", "ORDER", "BY", "ASC", "DESC", "LIMIT", "INSERT", "INTO", "VALUES", "CREATE", "TABLE", "PRIMARY", "KEY",
    "INT", "INTEGER", "TEXT", "FLOAT", "UPDATE", "SET", "DELETE", "NULL", "IS", "NOT", "AND", "OR", "BEGIN", "COMMIT", "ROLLBACK",
}
METRICS = {"<->": "euclidean", "<=>": "cosine", "<#>": "dot"}
_TOKEN = re.compile(
    r"\s+|(?P<metric><->|<=>|<\#>)|(?P<op><=|>=|!=|=|<|>)|(?P<mark>[(),*;\[\]])|'(?P<text>[^']*)'"
    r"|(?P<number>-?\d[\d.]*)|(?P<name>[^\W\d]\w*)"
)


@dataclass(frozen=True)
class Token:
    kind: str  # a keyword itself, or op, mark, text, number, name, end
    value: object


def tokens(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise SyntaxFailure(f"unexpected {sql[at]!r} at {at}")
        at, kind = m.end(), m.lastgroup
        if kind is None:
            continue
        value: object = m[kind]
        if kind == "name" and m[kind].upper() in KEYWORDS:
            kind = value = m[kind].upper()
        elif kind == "number":
            value = _number(m[kind])
        out.append(Token(kind, value))
    return [*out, Token("end", "the end")]


def _number(text: str) -> int | float:
    if "." in text:
        try:
            return float(text)
        except ValueError:
            raise SyntaxFailure(f"invalid number {text}") from None
    if not -(2**63) <= int(text) < 2**63:
        raise SyntaxFailure(f"{text} is out of range")
    return int(text)


class _Reader:
    def __init__(self, sql: str):
        self.todo, self.at = tokens(sql), 0

    @property
    def next(self) -> Token:
        return self.todo[self.at]

    def take(self, kind: str, value: object = None) -> object | None:
        """The next token's value if it is of this kind (and value), else None; NULL's value is its name."""
        t = self.next
        if t.kind != kind or value is not None and t.value != value:
            return None
        self.at += 1
        return t.value

    def need(self, kind: str, value: object = None):
        got = self.take(kind, value)
        if got is None:
            raise SyntaxFailure(f"expected {value or kind}, found {self.next.value!r}")
        return got

    def words(self, *kinds: str) -> None:
        for kind in kinds:
            self.need(kind)

    def listed(self, item) -> list:
        out = [item()]
        while self.take("mark", ","):
            out.append(item())
        return out

    def literal(self) -> Literal:
        t = self.next
        if t.kind not in ("number", "text", "NULL"):
            raise SyntaxFailure(f"expected a value, found {t.value!r}")
        self.at += 1
        return None if t.kind == "NULL" else t.value  # type: ignore[return-value]

    def predicate(self):
        parts = [self.conjunction()]
        while self.take("OR"):
            parts.append(self.conjunction())
        return parts[0] if len(parts) == 1 else Either(tuple(parts))

    def conjunction(self):
        parts = [self.condition()]
        while self.take("AND"):
            parts.append(self.condition())
        return parts[0] if len(parts) == 1 else Both(tuple(parts))

    def condition(self):
        if self.take("mark", "("):
            inner = self.predicate()
            self.need("mark", ")")
            return inner
        column = self.need("name")
        if self.take("IS"):
            negated = bool(self.take("NOT"))
            self.need("NULL")
            return IsNull(column, negated)
        return Compare(column, self.need("op"), self.literal())

    def where(self):
        return self.predicate() if self.take("WHERE") else None

    def create(self) -> CreateTable:
        self.need("TABLE")
        table = self.need("name")

        def column() -> NewColumn:
            name = self.need("name")
            kind = next((k for w, k in (("INT", INT), ("INTEGER", INT), ("TEXT", TEXT), ("FLOAT", FLOAT)) if self.take(w)), None)
            if kind is None:
                raise SyntaxFailure(f"expected a type, found {self.next.value!r}")
            key = bool(self.take("PRIMARY"))
            if key:
                self.need("KEY")
            return NewColumn(name, kind, key)

        self.need("mark", "(")
        columns = self.listed(column)
        self.need("mark", ")")
        return CreateTable(table, tuple(columns))

    def insert(self) -> Insert:
        self.need("INTO")
        table = self.need("name")
        self.need("VALUES")
        self.need("mark", "(")
        values = self.listed(self.literal)
        self.need("mark", ")")
        return Insert(table, tuple(values))

    def select(self) -> Select | Nearest:
        columns = None if self.take("mark", "*") else tuple(self.listed(lambda: self.need("name")))
        self.need("FROM")
        table, where, order = self.need("name"), self.where(), None
        metric = query = None
        if self.take("ORDER"):
            self.need("BY")
            name = self.need("name")
            if self.next.kind == "metric":
                metric = METRICS[self.need("metric")]
                self.need("mark", "[")
                query = tuple(float(x) for x in self.listed(lambda: self.need("number")))
                self.need("mark", "]")
            else:
                down = bool(self.take("DESC"))
                if not down:
                    self.take("ASC")
                order = (name, down)
        limit = None
        if self.take("LIMIT"):
            limit = self.need("number")
            if not isinstance(limit, int) or limit < 0:
                raise SyntaxFailure("LIMIT takes a whole number from 0")
        if metric:
            if limit is None:
                raise SyntaxFailure("an order by distance needs a LIMIT")
            return Nearest(table, columns, where, name, metric, query, limit)
        return Select(table, columns, where, order, limit)

    def update(self) -> Update:
        table = self.need("name")
        self.need("SET")

        def change() -> tuple[str, Literal]:
            name = self.need("name")
            self.need("op", "=")
            return name, self.literal()

        return Update(table, dict(self.listed(change)), self.where())

    def delete(self) -> Delete:
        self.need("FROM")
        return Delete(self.need("name"), self.where())

    def statement(self):
        for word, read in (("CREATE", self.create), ("INSERT", self.insert), ("SELECT", self.select), ("UPDATE", self.update), ("DELETE", self.delete)):
            if self.take(word):
                out = read()
                break
        else:
            word = next((w for w in ("BEGIN", "COMMIT", "ROLLBACK") if self.take(w)), None)
            if word is None:
                raise SyntaxFailure(f"expected a statement, found {self.next.value!r}")
            out = Control(word)
        self.take("mark", ";")
        self.need("end")
        return out


def parse(sql: str):
    return _Reader(sql).statement()
