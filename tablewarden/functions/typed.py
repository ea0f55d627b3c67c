"""Text cells as typed values. A cell that is not null but has no typed value does not parse."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Shapes that must hold before a cast is tried: casts alone accept more than the contract's types do.
FLOAT_SHAPE = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
DATE_SHAPE = r"^[+-]?[0-9]{4,}-[0-9]{1,2}-[0-9]{1,2}\z"
DATETIME_SHAPE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?|T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:[0-9]{2})| [0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:[0-9]{2}))?\z"
TRUE_WORDS, FALSE_WORDS = ("true", "t", "1", "yes", "y"), ("false", "f", "0", "no", "n")


#: The characters that Unicode calls white space: fixed values.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_SPACE))


_SPACE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*"


def shaped(c: Column, shape: str) -> Column:
    """Whether a cell has a shape but for white space around it. Most cells that do not are told by their first
    character, and only those that do are trimmed and cast."""
    return c.rlike(rf"^{_SPACE}(?:{shape.removeprefix('^').removesuffix(chr(92) + 'z')}){_SPACE}\z")


def cast_shaped(c: Column, shape: str, kind: str) -> Column:
    """The cast of a cell that has a shape. Trimming is slow, so a cell without white space around it is cast as it
    stands."""
    return F.when(c.rlike(shape), c.try_cast(kind)).when(shaped(c, shape), trimmed(c).try_cast(kind))


def parse_text(c: Column, kind: str) -> Column:
    """The typed value of a text cell, or null if it does not parse."""
    if kind == "string":
        return c
    t = trimmed(c)
    if kind == "int":
        return cast_shaped(c, r"^[+-]?[0-9]+\z", "bigint")
    if kind == "float":
        # what overflows to infinity does not parse
        return F.nullif(F.nullif(cast_shaped(c, FLOAT_SHAPE, "double"), F.lit(float("inf"))), F.lit(float("-inf")))
    if kind == "bool":
        low = F.lower(t)
        return F.when(low.isin(*TRUE_WORDS), F.lit(True)).when(low.isin(*FALSE_WORDS), F.lit(False))
    if kind == "date":
        return cast_shaped(c, DATE_SHAPE, "date")
    return cast_shaped(c, DATETIME_SHAPE, "timestamp")


def sketched(c: Column) -> Column:
    """An estimate of the distinct values, within about 1 %. The sketch is one binary buffer; a buffer of
    thousands of columns, as other estimators plan it, takes longer to plan than the data take to read."""
    return F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(c, F.lit(14))), F.lit(0))


#: Spark types that each contract type accepts from a source with types of its own.
ACCEPTS: dict[str, tuple[type, ...]] = {
    "string": (T.StringType, T.VarcharType, T.CharType),
    "int": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "float": (T.FloatType, T.DoubleType, T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "bool": (T.BooleanType,),
    "date": (T.DateType,),
    "datetime": (T.TimestampType, T.TimestampNTZType),
}


def accepts(kind: str, given: T.DataType) -> bool:
    if isinstance(given, T.DecimalType):
        return kind == "float" or kind == "int" and given.scale == 0
    return isinstance(given, ACCEPTS[kind])


def nested_kind(given: T.DataType) -> str | None:
    """What a nested column is called in errors; null for a scalar."""
    if isinstance(given, T.ArrayType):
        return "array"
    return "object" if isinstance(given, T.StructType | T.MapType | T.VariantType) else None


def as_text(c: Column, given: T.DataType) -> Column:
    """The text of a value of any scalar type; doubles in plain notation, without trailing zeros, as far as
    a whole number of 64 bits or 18 decimal places reach, and in the cast's own notation beyond."""
    if isinstance(given, T.StringType):
        return c
    if isinstance(given, T.FloatType | T.DoubleType | T.DecimalType):
        plain = F.regexp_replace(c.try_cast("decimal(38,18)").cast("string"), r"\.?0+\z", "")
        whole = F.when(c == F.floor(c), F.regexp_replace(c.try_cast("decimal(38,0)").cast("string"), r"^-0\z", "0"))
        return F.coalesce(whole, plain, c.cast("string"))
    if isinstance(given, T.BinaryType):
        return F.hex(c)
    return c.cast("string")


def native(c: Column, kind: str, given: T.DataType) -> Column:
    """A value of an accepted type as the contract's type."""
    names = {"int": "bigint", "float": "double", "bool": "boolean", "date": "date", "datetime": "timestamp", "string": "string"}
    return c.cast(names[kind])
