"""Value semantics of the pattern language as Spark expressions.

Values have one total order by kind: booleans, then numbers, then null (with lists and maps), then strings,
then bytes. Comparisons are never null: null equals null, is above every number and below every string.
Truth is two-valued: null is false, a boolean is itself, anything else is true.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANK = {"bool": 0, "num": 1, "none": 2, "str": 3, "bytes": 4}


def family(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.NumericType):
        return "num"
    if isinstance(kind, T.StringType):
        return "str"
    if isinstance(kind, T.BinaryType):
        return "bytes"
    return "none"


@dataclass
class Value:
    """A compiled expression: its column, Spark type and, where it is constant, the constant."""

    col: Column
    type: T.DataType
    constant: object = None
    literal: bool = False

    @property
    def family(self) -> str:
        return family(self.type)


def literal(x: object) -> Value:
    kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bytes: T.BinaryType(), bytearray: T.BinaryType(), type(None): T.NullType()}
    if type(x) in kinds:
        kind = kinds[type(x)]
        return Value(F.lit(x).cast(kind) if x is not None else F.lit(None), kind, x, True)
    if isinstance(x, (list, tuple)):
        parts = [literal(v) for v in x]
        if parts and all(p.family == "num" for p in parts) and len({type(v) for v in x}) > 1:
            parts = [Value(p.col.cast("double"), T.DoubleType()) for p in parts]
        inner = next((p.type for p in parts if not isinstance(p.type, T.NullType)), T.NullType())
        return Value(F.array(*[p.col.cast(inner) for p in parts]), T.ArrayType(inner), list(x), True)
    if isinstance(x, dict):
        return Value(F.map_from_arrays(F.array(*map(F.lit, x)), F.array(*[literal(v).col for v in x.values()])), T.MapType(T.StringType(), T.StringType()), x, True)
    raise TypeError(f"no value of the language: {type(x).__name__}")


def truth(v: Value) -> Column:
    if v.literal:
        return F.lit(v.constant if isinstance(v.constant, bool) else v.constant is not None)
    return F.coalesce(v.col, F.lit(False)) if v.family == "bool" else v.col.isNotNull()


def rank(v: Value) -> Column:
    if v.literal:
        return F.lit(2 if v.constant is None else RANK[v.family])
    return F.lit(2) if v.family == "none" else F.when(v.col.isNull(), 2).otherwise(RANK[v.family])


def compare(op: str, a: Value, b: Value, conjunct: bool = False) -> Column:
    """a op b under the total order. As a conjunct of a filter, where null and false are the same, the bare
    comparison is emitted where it can be, which Parquet scans can push down."""
    if op in (">", ">="):
        return compare({">": "<", ">=": "<="}[op], b, a, conjunct)
    if op == "<>":
        if (b.literal or a.literal) and a.family == b.family != "none":
            other = a if b.literal else b
            return (a.col != b.col) | other.col.isNull()
        return ~compare("=", a, b)
    if a.family != b.family or a.family == "none":
        ra, rb = rank(a), rank(b)
        return ra == rb if op == "=" else (ra < rb if op == "<" else ra <= rb)
    plain = {"=": a.col == b.col, "<": a.col < b.col, "<=": a.col <= b.col}[op]
    settle = lambda c: c if conjunct else F.coalesce(c, F.lit(False))
    if op == "=":
        return settle(plain) if a.literal or b.literal else a.col.eqNullSafe(b.col)
    null_low = RANK["none"] < RANK[a.family]
    if a.literal or b.literal:
        other = a if b.literal else b
        null_holds = null_low if other is a else not null_low
        return plain | other.col.isNull() if null_holds else settle(plain)
    first = a.col.isNull() if null_low else b.col.isNull()
    second = b.col.isNotNull() if null_low else a.col.isNotNull()
    both = a.col.isNull() & b.col.isNull() if op == "<=" else F.lit(False)
    return F.coalesce(plain, (first & second) | both)


def arithmetic(op: str, a: Value, b: Value) -> Value:
    """Whole numbers stay whole; a whole division truncates and by zero gives 0; numbers mix to double, whose
    division by zero gives infinities or NaN; anything else is null."""
    if a.family != "num" or b.family != "num":
        return Value(F.lit(None), T.NullType())
    if isinstance(a.type, T.IntegralType) and isinstance(b.type, T.IntegralType):
        x, y = a.col.cast("bigint"), b.col.cast("bigint")
        if op == "/":
            whole = F.call_function("try_divide", x - F.try_mod(x, y), y).cast("bigint")  # what is left divides evenly
            return Value(F.when(y == 0, F.when(x.isNotNull(), F.lit(0).cast("bigint"))).otherwise(whole), T.LongType())
        return Value({"+": x + y, "-": x - y, "*": x * y}[op], T.LongType())
    x, y = a.col.cast("double"), b.col.cast("double")
    if op == "/":
        inf = float("inf")
        zero = F.when(x > 0, inf).when(x < 0, -inf).when(x.isNotNull(), float("nan"))
        return Value(F.when(y == 0, zero).otherwise(x / F.nullif(y, F.lit(0.0))), T.DoubleType())
    return Value({"+": x + y, "-": x - y, "*": x * y}[op], T.DoubleType())


def sort_keys(v: Value, ascending: bool) -> list[Column]:
    """ORDER BY keys: null after numbers and booleans, before strings and bytes."""
    low = v.family in ("str", "bytes")
    if ascending:
        return [v.col.asc_nulls_first() if low else v.col.asc_nulls_last()]
    return [v.col.desc_nulls_last() if low else v.col.desc_nulls_first()]
