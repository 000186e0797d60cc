"""A fluent builder of queries and changes; each step gives DataFrames, so Catalyst plans the whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT = object()
_JOINS = {"inner", "left", "right", "full", "cross", "left_semi", "left_anti"}


class WholeTableDelete(ValueError):
    """A delete without a condition that wasn't forced."""


class Query:
    """select().from_().where().and_().or_().group_by().having().order_by().limit().offset().

    and_ binds tighter than or_, as no brackets are written. Comparisons with `column=True` name another column.
    """

    def __init__(self, tables: dict[str, DataFrame]):
        self.tables = tables
        self._select: list = []
        self._from: list[str] = []
        self._joins: list[tuple[str, Column | None, str]] = []
        self._terms: list[list[Column]] = []
        self._group: list[str] = []
        self._aggs: list[Column] = []
        self._having: Column | None = None
        self._order: list[Column] = []
        self._limit: int | None = None
        self._offset = 0
        self._distinct: list[str] = []

    def select(self, *columns):
        self._select += columns
        return self

    def from_(self, *names: str):
        """Several names give their cross product."""
        self._from += names
        return self

    def join(self, name: str, on: Column | None = None, how: str = "inner"):
        if how not in _JOINS:
            raise ValueError(f"unknown join {how}")
        self._joins.append((name, on, how))
        return self

    def distinct(self, *columns: str):
        """One row for every combination of columns: the first in the query's order."""
        self._distinct += columns
        return self

    @staticmethod
    def _test(condition: Column | str, value, column: bool) -> Column:
        if isinstance(condition, Column):
            return condition
        name, _, op = condition.partition(" ")
        left, right = F.col(name), F.col(value) if column else F.lit(value)
        op = op.strip() or "="
        tests = {"=": left == right, "<>": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}
        if op == "in":
            return left.isin(list(value))
        if op == "like":
            return left.like(value)
        return tests[op]

    def where(self, condition, value=None, column: bool = False):
        self._terms = [[self._test(condition, value, column)]]
        return self

    def and_(self, condition, value=None, column: bool = False):
        self._terms[-1].append(self._test(condition, value, column))
        return self

    def or_(self, condition, value=None, column: bool = False):
        self._terms.append([self._test(condition, value, column)])
        return self

    def group_by(self, *columns: str, **aggregates: Column):
        self._group += columns
        self._aggs += [c.alias(n) for n, c in aggregates.items()]
        return self

    def having(self, condition: Column | str):
        self._having = F.expr(condition) if isinstance(condition, str) else condition
        return self

    def order_by(self, *columns: str, desc: bool = False):
        """One direction for the list, which SQL applies to its last column."""
        self._order = [F.col(c).asc() for c in columns[:-1]] + [F.col(columns[-1]).desc() if desc else F.col(columns[-1]).asc()]
        return self

    def limit(self, n: int):
        self._limit = n
        return self

    def offset(self, n: int):
        self._offset = n
        return self

    def condition(self) -> Column | None:
        if not self._terms:
            return None
        return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, t) for t in self._terms])

    def frame(self) -> DataFrame:
        df = reduce(lambda a, b: a.crossJoin(b), [self.tables[n] for n in self._from])
        for name, on, how in self._joins:
            df = df.crossJoin(self.tables[name]) if how == "cross" else df.join(self.tables[name], on, how)
        if (c := self.condition()) is not None:
            df = df.filter(c)
        if self._group:
            df = df.groupBy(*self._group).agg(*self._aggs)
        if self._having is not None:
            df = df.filter(self._having)
        if self._distinct:
            from .harvest import latest

            df = latest(df, self._distinct, self._order or [F.col(c) for c in df.columns])
        if self._order:
            df = df.orderBy(*self._order)
        if self._offset:
            df = df.offset(self._offset)
        if self._limit is not None:
            df = df.limit(self._limit)
        return df.select(*self._select) if self._select else df

    def count(self) -> int:
        return self.frame().count()

    def fetch_one(self):
        return self.frame().first()

    def fetch_all(self) -> list:
        return self.frame().collect()


def insert(table: DataFrame, rows: list[dict], defaults: dict | None = None) -> DataFrame:
    """Rows over the union of their columns; what a row lacks, or has as DEFAULT, comes from defaults or is null."""
    defaults = defaults or {}
    full = [{f.name: (defaults.get(f.name) if r.get(f.name, DEFAULT) is DEFAULT else r[f.name]) for f in table.schema.fields} for r in rows]
    new = table.sparkSession.createDataFrame([tuple(r[c] for c in table.columns) for r in full], table.schema)
    return table.unionByName(new)


def update(table: DataFrame, condition: Column, changes: dict, defaults: dict | None = None) -> DataFrame:
    """Changed columns of the rows that meet the condition: a value, a Column, `+=n`, `-=n`, DEFAULT, or None."""
    out = {}
    for name, v in changes.items():
        if v is DEFAULT:
            new = F.lit((defaults or {}).get(name))
        elif isinstance(v, str) and v[:2] in ("+=", "-="):
            new = F.col(name) + float(v[2:]) * (1 if v[0] == "+" else -1)
        else:
            new = v if isinstance(v, Column) else F.lit(v)
        out[name] = F.when(condition, new.cast(table.schema[name].dataType)).otherwise(F.col(name))
    return table.withColumns(out)


def delete(table: DataFrame, condition: Column | None, force: bool = False) -> DataFrame:
    """Rows that don't meet the condition (an unknown one counts as not met); a whole table only by force."""
    if condition is None:
        if not force:
            raise WholeTableDelete("no condition; force it to delete all rows")
        return table.limit(0)
    return table.filter(~F.coalesce(condition, F.lit(False)))


def returning(table: DataFrame, condition: Column, *columns: str) -> DataFrame:
    return table.filter(condition).select(*columns)


def fulltext(table: DataFrame, columns: list[str], words: str) -> DataFrame:
    """Rows whose columns together meet a query of words with &, |, ! and brackets."""
    import re

    from ..functions.text import tokens

    text = tokens(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
    parts = re.findall(r"[&|!()]|[^\s&|!()]+", words.lower())
    at = 0

    def either() -> Column:
        nonlocal at
        left = both()
        while at < len(parts) and parts[at] == "|":
            at += 1
            left = left | both()
        return left

    def both() -> Column:
        nonlocal at
        left = one()
        while at < len(parts) and parts[at] == "&":
            at += 1
            left = left & one()
        return left

    def one() -> Column:
        nonlocal at
        p = parts[at]
        at += 1
        if p == "!":
            return ~one()
        if p == "(":
            inner = either()
            at += 1
            return inner
        return F.array_contains(text, p)

    return table.filter(either())
