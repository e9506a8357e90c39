"""Boolean filters of one level: all of must, one of should (if there are any), none of must_not."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATORS = ("eq", "in")


@dataclass(frozen=True)
class Condition:
    """A key, an operator (eq or in) and its value. Key and operator are trimmed."""

    key: str
    operator: str
    value: object

    def checked(self) -> Condition:
        key, op = self.key.strip(), self.operator.strip()
        if not key:
            raise ValueError("a condition needs a key")
        if op not in OPERATORS:
            raise ValueError(f"unknown operator {op!r}")
        if op == "eq":
            if not isinstance(self.value, (str, bool, int)) or isinstance(self.value, int) and not isinstance(self.value, bool) and not -(2**63) <= self.value < 2**63:
                raise ValueError("eq takes a string, a boolean or a whole number of 64 bits")
        else:
            kinds = {bool if isinstance(v, bool) else type(v) for v in self.value} if isinstance(self.value, (list, tuple)) else set()
            if len(kinds) != 1 or kinds - {str, int}:
                raise ValueError("in takes a list of strings or of whole numbers, not empty and not mixed")
        return Condition(key, op, self.value)

    @staticmethod
    def decoded(message: dict) -> Condition:
        """From a message with one of string_value, bool_value, int_value, string_values, int_values; scalars win over lists."""
        for name in ("string_value", "bool_value", "int_value"):
            if message.get(name) is not None:
                return Condition(message.get("key", ""), message.get("operator", ""), message[name])
        for name in ("string_values", "int_values"):
            if message.get(name):
                return Condition(message.get("key", ""), message.get("operator", ""), list(message[name]))
        return Condition(message.get("key", ""), message.get("operator", ""), None)


@dataclass(frozen=True)
class Filter:
    must: list[Condition] = field(default_factory=list)
    should: list[Condition] = field(default_factory=list)
    must_not: list[Condition] = field(default_factory=list)

    @property
    def empty(self) -> bool:
        return not (self.must or self.should or self.must_not)


def condition_column(c: Condition, schema: T.StructType) -> Column:
    """True where the row has the value; false, never null, for nulls and for keys that the table lacks. On arrays: any element."""
    c = c.checked()
    kinds = {f.name: f.dataType for f in schema.fields}
    if c.key not in kinds:
        return F.lit(False)
    col, values = F.col(f"`{c.key}`"), list(c.value) if c.operator == "in" else [c.value]
    kind = kinds[c.key]
    if isinstance(kind, T.ArrayType):
        atom = F.arrays_overlap(col, F.array(*[F.lit(v).cast(kind.elementType) for v in values]))
    else:
        same = {T.StringType: str, T.BooleanType: bool}.get(type(kind), int)
        if any(isinstance(v, bool) != (same is bool) or not isinstance(v, same) for v in values):
            return F.lit(False)  # a value of another kind matches nothing
        atom = col.isin(values) if len(values) > 1 else col == F.lit(values[0])
    return F.coalesce(atom, F.lit(False))


def filter_column(f: Filter | None, schema: T.StructType) -> Column | None:
    """The filter as one boolean column, or None if it is empty."""
    if f is None or f.empty:
        return None
    parts = [condition_column(c, schema) for c in f.must]
    if f.should:
        parts.append(reduce(lambda a, b: a | b, [condition_column(c, schema) for c in f.should]))
    parts += [~condition_column(c, schema) for c in f.must_not]
    return reduce(lambda a, b: a & b, parts)


def filtered(df: DataFrame, f: Filter | None) -> DataFrame:
    column = filter_column(f, df.schema)
    return df if column is None else df.filter(column)
