"""Lexer, syntax tree and recursive-descent parser of the query language."""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass, field

from ..errors import MemoryLimitError, SchemaError, SyntaxSqlError
from ..types import INT64_MAX, SQL_NAMES, ColumnDef

MAX_DEPTH, MAX_NODES, MAX_ITEMS, MAX_TERMS, MAX_COLUMNS, MAX_PARAMS = 200, 10_000, 64, 16, 16, 16
#: Words that can't be names, and all functions.
RESERVED = {"SELECT", "FROM", "WHERE", "GROUP", "BY", "HAVING", "ORDER", "LIMIT", "OFFSET", "ASC", "DESC", "AND", "OR", "NOT", "LIKE", "IS", "NULL", "BETWEEN", "AS", "VALUES", "INTO"}
AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX"}
SCALARS = {"ABS", "ROUND", "LENGTH", "LOWER", "UPPER"}
COMPARISONS = {"=", "<>", "<", "<=", ">", ">="}

_TOKEN = re.compile(
    r"(?P<skip>(?:[ \t\n\r]+|--[^\n]*)+)|(?P<id>[A-Za-z_][A-Za-z_0-9]*)|(?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
    r"|(?P<str>'(?:[^']|'')*')|(?P<op><=|>=|<>|!=|==|[(),*+\-/%=<>;?])"
)


@dataclass
class Token:
    kind: str  # id, num, str, op, end
    text: str
    start: int
    end: int


def lex(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            if sql[at] == "'":
                raise SyntaxSqlError("unterminated string near end")
            raise SyntaxSqlError(f"unexpected character {sql[at]}")
        if m.lastgroup != "skip":
            out.append(Token(m.lastgroup, m[0], at, m.end()))
        at = m.end()
    return [*out, Token("end", "end", at, at)]


@dataclass
class Node:
    """An expression. ``src`` is its exact source text and no part of its identity."""

    src: str = field(default="", compare=False, kw_only=True)

    def children(self) -> list[Node]:
        return [x for k, v in self.__dict__.items() if k != "src" for x in (v if isinstance(v, list) else [v]) if isinstance(x, Node)]


@dataclass
class Lit(Node):
    value: int | float | str | None


@dataclass
class Name(Node):
    name: str


@dataclass
class Col(Node):
    """A resolved column."""

    index: int


@dataclass
class Param(Node):
    index: int


@dataclass
class Neg(Node):
    a: Node


@dataclass
class Not(Node):
    a: Node


@dataclass
class Bin(Node):
    op: str
    a: Node
    b: Node


@dataclass
class Logic(Node):
    op: str  # AND, OR
    a: Node
    b: Node


@dataclass
class IsNull(Node):
    a: Node
    negated: bool


@dataclass
class Between(Node):
    a: Node
    low: Node
    high: Node
    negated: bool


@dataclass
class Like(Node):
    a: Node
    pattern: Node
    negated: bool


@dataclass
class Fn(Node):
    name: str
    args: list[Node]
    star: bool = False


@dataclass
class Item:
    expr: Node
    alias: str | None = None


@dataclass
class Select:
    items: list[Item]
    star: bool = False
    table: str | None = None
    where: Node | None = None
    group: list[Node] = field(default_factory=list)
    having: Node | None = None
    order: list[tuple[Node, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0
    explain: bool = False


@dataclass
class CreateTable:
    name: str
    columns: list[ColumnDef]
    key: list[str]
    if_not_exists: bool


@dataclass
class DropTable:
    name: str
    if_exists: bool


@dataclass
class CreateIndex:
    name: str
    table: str
    columns: list[str]
    unique: bool
    if_not_exists: bool


@dataclass
class DropIndex:
    name: str
    if_exists: bool


@dataclass
class Insert:
    table: str
    columns: list[str] | None
    rows: list[list[Node]]
    replace: bool


@dataclass
class Update:
    table: str
    sets: list[tuple[str, Node]]
    where: Node | None


@dataclass
class Delete:
    table: str
    where: Node | None


def depth_and_size(e: Node) -> tuple[int, int]:
    """Levels and nodes of a tree, without recursion; trees shared through aliases count each time, up to the limit."""
    deepest, size, stack = 0, 0, [(e, 1)]
    while stack and size <= MAX_NODES and deepest <= MAX_DEPTH:
        node, d = stack.pop()
        deepest, size = max(deepest, d), size + 1
        stack += [(c, d + 1) for c in node.children()]
    return deepest, size


def walk(e: Node):
    stack = [e]
    while stack:
        node = stack.pop()
        yield node
        stack += node.children()


def is_constant(e: Node) -> bool:
    return not any(isinstance(x, (Name, Col)) or isinstance(x, Fn) and x.name in AGGREGATES for x in walk(e))


class Parser:
    def __init__(self, sql: str):
        self.sql, self.tokens, self.at, self.nest, self.params = sql, lex(sql), 0, 0, 0

    # -- tokens

    @property
    def t(self) -> Token:
        return self.tokens[self.at]

    def fail(self, what: str, near: bool = True):
        raise SyntaxSqlError(what + (" near " + self.t.text if near else ""))

    def is_op(self, *ops: str) -> bool:
        return self.t.kind == "op" and self.t.text in ops

    def is_kw(self, *words: str) -> bool:
        return self.t.kind == "id" and self.t.text.upper() in words

    def accept_op(self, op: str) -> bool:
        hit = self.is_op(op)
        self.at += hit
        return hit

    def accept_kw(self, word: str) -> bool:
        hit = self.is_kw(word)
        self.at += hit
        return hit

    def expect_op(self, op: str) -> None:
        if not self.accept_op(op):
            self.fail(f"expected {op}")

    def expect_kw(self, *words: str) -> None:
        for w in words:
            if not self.accept_kw(w):
                self.fail(f"expected {w}")

    def name(self, what: str, most: int | None = None) -> str:
        if self.t.kind != "id" or most and len(self.t.text) > most:
            self.fail(f"expected {what}")
        self.at += 1
        return self.tokens[self.at - 1].text

    def made(self, node: Node, first: int) -> Node:
        node.src = self.sql[self.tokens[first].start : self.tokens[self.at - 1].end]
        return node

    # -- statements

    def statements(self) -> list:
        old = sys.getrecursionlimit()
        sys.setrecursionlimit(max(old, 20 * MAX_DEPTH + 2000))
        try:
            out = []
            while self.t.kind != "end":
                if not self.accept_op(";"):
                    out.append(self.statement())
                    if self.t.kind != "end" and not self.is_op(";"):
                        self.fail("syntax error")
            return out
        finally:
            sys.setrecursionlimit(old)

    def statement(self):
        if self.accept_kw("EXPLAIN"):
            self.expect_kw("SELECT")
            out = self.select()
            out.explain = True
            return out
        for word, parse in (("SELECT", self.select), ("CREATE", self.create), ("INSERT", self.insert), ("UPDATE", self.update), ("DELETE", self.delete), ("DROP", self.drop)):
            if self.accept_kw(word):
                return parse()
        self.fail("expected SELECT, CREATE, INSERT, UPDATE, DELETE, DROP or EXPLAIN")

    def select(self) -> Select:
        out = Select([])
        if self.accept_op("*"):
            out.star = True
        else:
            while True:
                if len(out.items) >= MAX_ITEMS:
                    raise MemoryLimitError("too many result columns")
                item = Item(self.expr())
                if self.accept_kw("AS") or self.t.kind == "id" and self.t.text.upper() not in RESERVED:
                    item.alias = self.name("a name after AS")
                out.items.append(item)
                if not self.accept_op(","):
                    break
        if self.accept_kw("FROM"):
            out.table = self.name("a table name")
        if self.accept_kw("WHERE"):
            out.where = self.expr()
        if self.accept_kw("GROUP"):
            self.expect_kw("BY")
            out.group = self.terms("GROUP BY", self.expr)
        if self.accept_kw("HAVING"):
            out.having = self.expr()
        if self.accept_kw("ORDER"):
            self.expect_kw("BY")
            out.order = self.terms("ORDER BY", self.order_term)
        if self.accept_kw("LIMIT"):
            out.limit = self.whole("LIMIT")
            if self.accept_kw("OFFSET"):
                out.offset = self.whole("OFFSET")
        return out

    def terms(self, what: str, parse) -> list:
        out = [parse()]
        while self.accept_op(","):
            if len(out) >= MAX_TERMS:
                raise MemoryLimitError(f"too many {what} terms")
            out.append(parse())
        return out

    def order_term(self) -> tuple[Node, bool]:
        e = self.expr()
        desc = self.accept_kw("DESC")
        if not desc:
            self.accept_kw("ASC")
        return e, desc

    def whole(self, what: str) -> int:
        if self.t.kind != "num" or not self.t.text.isdigit():
            self.fail(f"{what} needs a whole number")
        self.at += 1
        return int(self.tokens[self.at - 1].text)

    def if_exists(self, negated: bool) -> bool:
        if not self.accept_kw("IF"):
            return False
        self.expect_kw(*(("NOT", "EXISTS") if negated else ("EXISTS",)))
        return True

    def create(self):
        unique = self.accept_kw("UNIQUE")
        if unique:
            self.expect_kw("INDEX")
        if unique or self.accept_kw("INDEX"):
            soft = self.if_exists(True)
            name = self.name("an index name")
            self.expect_kw("ON")
            table = self.name("a table name")
            self.expect_op("(")
            columns = []
            while True:
                if len(columns) >= 4:
                    raise SchemaError("an index has 1 to 4 columns")
                columns.append(self.name("a column name"))
                self.accept_kw("ASC")
                if not self.accept_op(","):
                    break
            self.expect_op(")")
            return CreateIndex(name, table, columns, unique, soft)
        self.expect_kw("TABLE")
        soft = self.if_exists(True)
        name = self.name("a table name of up to 31 characters", 31)
        self.expect_op("(")
        columns: list[ColumnDef] = []
        key: list[str] = []
        while True:
            if self.accept_kw("PRIMARY"):
                self.expect_kw("KEY")
                self.expect_op("(")
                if key:
                    self.fail("one primary key per table", near=False)
                while True:
                    c = self.name("a column name")
                    known = next((x.name for x in columns if x.name.lower() == c.lower()), None)
                    if known is None:
                        raise SchemaError(f"no such column: {c}")
                    if known in key:
                        raise SchemaError("a column appears twice in the key")
                    key.append(known)
                    if not self.accept_op(","):
                        break
                self.expect_op(")")
            else:
                c = self.name("a column name", 31)
                if len(columns) >= MAX_COLUMNS:
                    raise SchemaError("SQL tables have up to 16 columns")
                if any(x.name.lower() == c.lower() for x in columns):
                    raise SchemaError(f"column named twice: {c}")
                if self.t.kind != "id" or self.t.text.upper() not in SQL_NAMES:
                    self.fail("expected a type (TIME, INT, INTEGER, FLOAT, REAL, TEXT)")
                columns.append(ColumnDef(c, SQL_NAMES[self.t.text.upper()]))
                self.at += 1
                if self.accept_op("("):
                    while self.t.kind != "end" and not self.is_op(")"):
                        self.at += 1
                    self.expect_op(")")
                if self.accept_kw("PRIMARY"):
                    self.expect_kw("KEY")
                    if key:
                        self.fail("one primary key per table", near=False)
                    key.append(c)
            if not self.accept_op(","):
                break
        self.expect_op(")")
        return CreateTable(name, columns, key, soft)

    def drop(self):
        if self.accept_kw("INDEX"):
            soft = self.if_exists(False)
            return DropIndex(self.name("an index name"), soft)
        self.expect_kw("TABLE")
        soft = self.if_exists(False)
        return DropTable(self.name("a table name"), soft)

    def insert(self) -> Insert:
        replace = self.accept_kw("OR")
        if replace:
            self.expect_kw("REPLACE")
        self.expect_kw("INTO")
        table, columns = self.name("a table name"), None
        if self.accept_op("("):
            columns = [self.name("a column name")]
            while self.accept_op(","):
                columns.append(self.name("a column name"))
            self.expect_op(")")
        self.expect_kw("VALUES")
        rows = []
        while True:
            self.expect_op("(")
            row = [self.expr()]
            while self.accept_op(","):
                row.append(self.expr())
            self.expect_op(")")
            for e in row:
                if not is_constant(e):
                    raise SchemaError(f"values must be constants: {e.src}")
            rows.append(row)
            if not self.accept_op(","):
                return Insert(table, columns, rows, replace)

    def update(self) -> Update:
        table = self.name("a table name")
        self.expect_kw("SET")
        sets: list[tuple[str, Node]] = []
        while True:
            c = self.name("a column name")
            if any(x.lower() == c.lower() for x, _ in sets):
                raise SchemaError(f"column set twice: {c}")
            self.expect_op("=")
            sets.append((c, self.expr()))
            if not self.accept_op(","):
                return Update(table, sets, self.expr() if self.accept_kw("WHERE") else None)

    def delete(self) -> Delete:
        self.expect_kw("FROM")
        table = self.name("a table name")
        return Delete(table, self.expr() if self.accept_kw("WHERE") else None)

    # -- expressions, loosest first

    def deeper(self) -> None:
        self.nest += 1
        if self.nest > MAX_DEPTH:
            self.fail("expression nested too deeply", near=False)

    def expr(self) -> Node:
        self.deeper()
        e = self.chain("OR", lambda: self.chain("AND", self.negation))
        self.nest -= 1
        if depth_and_size(e)[0] > MAX_DEPTH:
            self.fail("expression nested too deeply", near=False)
        return e

    def chain(self, word: str, part) -> Node:
        first, e = self.at, part()
        while self.accept_kw(word):
            e = self.made(Logic(word, e, part()), first)
        return e

    def negation(self) -> Node:
        first = self.at
        if not self.accept_kw("NOT"):
            return self.comparison()
        self.deeper()
        e = self.made(Not(self.negation()), first)
        self.nest -= 1
        return e

    def comparison(self) -> Node:
        first, e = self.at, self.sum()
        if self.t.kind == "op" and (op := {"==": "=", "!=": "<>"}.get(self.t.text, self.t.text)) in COMPARISONS:
            self.at += 1
            return self.made(Bin(op, e, self.sum()), first)
        if self.accept_kw("IS"):
            negated = self.accept_kw("NOT")
            self.expect_kw("NULL")
            return self.made(IsNull(e, negated), first)
        negated = self.accept_kw("NOT")
        if self.accept_kw("LIKE"):
            return self.made(Like(e, self.sum(), negated), first)
        if self.accept_kw("BETWEEN"):
            low = self.sum()
            self.expect_kw("AND")
            return self.made(Between(e, low, self.sum(), negated), first)
        if self.is_kw("IN"):
            return self.members(e, negated, first)
        if negated:
            self.fail("expected LIKE, BETWEEN or IN")
        return e

    def members(self, e: Node, negated: bool, first: int) -> Node:
        """column [NOT] IN (constants): a chain of comparisons, which the planner reads as a key list."""
        if not isinstance(e, Name):
            self.fail("IN takes a column on its left")
        self.at += 1
        self.expect_op("(")
        out = None
        while True:
            one = self.at
            sign = self.accept_op("-")
            if not sign:
                self.accept_op("+")
            if self.t.kind not in ("num", "str") and not self.is_op("?") and not self.is_kw("NULL") or sign and self.t.kind != "num":
                self.fail("IN takes constants")
            v = self.primary()
            if sign:
                v = self.made(Neg(v), one)
            same = Bin("<>" if negated else "=", Name(e.name, src=e.src), v, src=e.src)
            out = same if out is None else Logic("AND" if negated else "OR", out, same)
            if not self.accept_op(","):
                break
        self.expect_op(")")
        return self.made(out, first)

    def sum(self) -> Node:
        return self.left("+-", lambda: self.left("*/%", self.unary))

    def left(self, ops: str, part) -> Node:
        first, e = self.at, part()
        while self.t.kind == "op" and self.t.text in ops:
            self.at += 1
            e = self.made(Bin(self.tokens[self.at - 1].text, e, part()), first)
        return e

    def unary(self) -> Node:
        first = self.at
        if not self.is_op("-", "+"):
            return self.primary()
        minus = self.is_op("-")
        self.at += 1
        self.deeper()
        e = self.unary()
        self.nest -= 1
        return self.made(Neg(e), first) if minus else e

    def primary(self) -> Node:
        first, t = self.at, self.t
        self.at += 1
        if t.kind == "num":
            whole = t.text.isdigit() and int(t.text) <= INT64_MAX
            return self.made(Lit(int(t.text) if whole else float(t.text)), first)
        if t.kind == "str":
            return self.made(Lit(t.text[1:-1].replace("''", "'")), first)
        if t.kind == "op" and t.text == "?":
            self.params += 1
            if self.params > MAX_PARAMS:
                self.fail("up to 16 parameters", near=False)
            return self.made(Param(self.params - 1), first)
        if t.kind == "op" and t.text == "(":
            e = self.expr()
            self.expect_op(")")
            return e
        if t.kind == "id" and t.text.upper() == "NULL":
            return self.made(Lit(None), first)
        if t.kind == "id" and t.text.upper() not in RESERVED:
            if not self.accept_op("("):
                return self.made(Name(t.text), first)
            fn = t.text.upper()
            if fn not in AGGREGATES | SCALARS:
                raise SyntaxSqlError(f"unknown function {t.text}")
            if fn == "COUNT" and self.accept_op("*"):
                args, star = [], True
            else:
                args, star = [self.expr()], False
                if self.accept_op(","):
                    args.append(self.expr())
            self.expect_op(")")
            if len(args) > 1 and fn != "ROUND":
                self.fail("wrong number of arguments")
            return self.made(Fn(fn, args, star), first)
        self.at = first
        self.fail("syntax error")


def parse(sql: str) -> tuple[list, int]:
    """The statements of ``sql`` and how many parameters they have."""
    p = Parser(sql)
    return p.statements(), p.params
