"""Column helpers: key predicates and rendering, qualified names, sizes, canonical text of values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def complete_key(cols: Sequence[str]) -> Column:
    """MATCH SIMPLE: a row is examined only if every key column is present."""
    if not cols:
        raise ValueError("a key has at least one column")
    return reduce(and_, (F.col(c).isNotNull() for c in cols))


def render_key(cols: Sequence[str]) -> Column:
    """`col=value, col=value`; `(no pk)` for a table without key."""
    return F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("NULL"))) for c in cols]) if cols else F.lit("(no pk)")


def split_qualified(name: Column) -> tuple[Column, Column]:
    """(owner, class) of a qualified name: what follows the last dot is the class; both in lower case."""
    low = F.lower(name)
    cls = F.substring_index(low, ".", -1)
    return F.when(low.contains("."), F.substr(low, F.lit(1), F.length(low) - F.length(cls) - 1)), cls


def human_bytes(size: Column) -> Column:
    """Bytes with a binary unit and one decimal."""
    out = F.concat(size.cast("long").cast("string"), F.lit(" B"))
    for power, unit in ((10, "KiB"), (20, "MiB"), (30, "GiB"), (40, "TiB")):
        out = F.when(size >= 1 << power, F.concat(F.format_number(size / (1 << power), 1), F.lit(f" {unit}"))).otherwise(out)
    return out


def utc_text(ts: Column) -> Column:
    """A timestamp of the session as `yyyy-MM-ddTHH:mm:ssZ` in UTC."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def canonical(df: DataFrame) -> Column:
    """One text for a row that equal rows share and unequal rows of the same types don't.

    Each value is led by its length in bytes, and so is each member of an array, a struct or a map, so that no value can look like two; null has
    a mark of its own. Floating-point values are written in full, zero without sign; instants as microseconds since the epoch,
    whatever the session's zone; times without zone as written; maps in the order of their entries' texts.
    """
    return F.concat(*[_led(_value(F.col(f"`{f.name}`"), f.dataType)) for f in df.schema]) if df.columns else F.lit("")


def _led(text: Column) -> Column:
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("~"))


def _value(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.DoubleType | T.FloatType):
        return F.when(c == 0, F.lit("0.0")).otherwise(c.cast("string"))
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("string")
    if isinstance(kind, T.BinaryType):
        return F.hex(c)
    if isinstance(kind, T.ArrayType):
        return F.array_join(F.transform(c, lambda x: _led(_value(x, kind.elementType))), "")
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.concat(F.lit(""), *[_led(_value(c[f.name], f.dataType)) for f in kind]))
    if isinstance(kind, T.MapType):
        entry = lambda e: F.concat(_led(_value(e["key"], kind.keyType)), _led(_value(e["value"], kind.valueType)))
        return F.array_join(F.array_sort(F.transform(F.map_entries(c), entry)), "")
    return c.cast("string")


def sql_row(df: DataFrame) -> Column:
    """As canonical, with scalars as SQL's CAST to VARCHAR writes them, so that another engine can give the same text.

    Floating-point values stand in fixed notation from 1e-4 up to 1e16, and zero keeps its sign; instants are times in UTC.
    """
    return F.concat(*[_led(_sql_value(F.col(f"`{f.name}`"), f.dataType)) for f in df.schema]) if df.columns else F.lit("")


def _sql_value(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.DoubleType | T.FloatType):
        return _sql_float(c.cast("string"))
    if isinstance(kind, T.TimestampType):
        return F.to_utc_timestamp(c, F.current_timezone()).cast("timestamp_ntz").cast("string")
    return _value(c, kind)


def _sql_float(text: Column) -> Column:
    """Spark's text of a floating-point value, which has an exponent from 1e7 up and below 1e-3, rewritten."""
    digits, power = F.substring_index(text, "E", 1), F.substring_index(text, "E", -1).try_cast("int")
    fixed = F.regexp_replace(text.try_cast("decimal(38,21)").cast("string"), r"(\.\d+?)0*$", "$1")
    sign = F.when(power < 0, "-").otherwise("+")
    short = F.concat(F.regexp_replace(digits, r"\.0$", ""), F.lit("e"), sign, F.lpad(F.abs(power).cast("string"), F.greatest(F.length(F.abs(power).cast("string")), F.lit(2)), F.lit("0")))
    special = F.when(text == "NaN", "nan").when(text == "Infinity", "inf").when(text == "-Infinity", "-inf")
    return F.coalesce(special, F.when(~F.contains(text, F.lit("E")), text).when(power.between(-4, 15), fixed).otherwise(short))


def json_text(col: Column, path: str) -> Column:
    """The value at a path of a JSON text, as text; null where the path or the text is none."""
    return F.get_json_object(col, path)


def instant(text: Column) -> Column:
    """A zoned time as an instant: `yyyy-MM-dd HH:mm:ss[.f]` followed by an offset or the name of a zone, after a space or not."""
    zone = F.trim(F.regexp_extract(text, r"^\S+[ T][0-9:.]+ *(.*)$", 1))
    at = F.regexp_extract(text, r"^(\S+[ T][0-9:.]+)", 1)
    return F.try_to_timestamp(F.concat_ws(" ", at, F.nullif(zone, F.lit(""))))


def same_items(a: Column, b: Column, kind: str) -> Column:
    """Equality of collections: of a `set` by distinct members, of a `multiset` by members and how often, of a `sequence` in order."""
    form = {"set": lambda x: F.array_sort(F.array_distinct(x)), "multiset": F.array_sort, "sequence": lambda x: x}[kind]
    return form(a).eqNullSafe(form(b))
