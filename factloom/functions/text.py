"""Value recognisers and text forms (V1-V7, V14) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The accepted spellings of numbers, dates and booleans.
NUMBER = r"^[-+]?[$€£]?(?U:\s)?([0-9]{1,3}(,[0-9]{3})+|[0-9]+)(\.[0-9]+)?%?$"
NUMBER_NOISE = "$€£,%+"
ISO_DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
ISO_TIMESTAMP = (
    r"^([0-9]{4}-[0-9]{2}-[0-9]{2})[T ]([0-9]{2}:[0-9]{2})(:[0-9]{2})?(\.[0-9]+)?"
    r"(Z|[+-][0-9]{2}:?[0-9]{2})?$"
)
US_DATE = r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$"
BOOLEANS = {"true": True, "false": False, "yes": True, "no": False}


# The characters Unicode calls white space; ``trim`` alone only knows the plain one.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_measurable(dtype: T.DataType) -> bool:
    """Types an aggregate can see as numbers; booleans count as 1/0."""
    return is_number(dtype) or isinstance(dtype, T.BooleanType)


def trimmed(c: Column) -> Column:
    """Without leading and trailing Unicode white space."""
    c = c.cast("string")
    # Nearly every cell starts and ends with a visible ASCII character already.
    bare = F.substring(c, 1, 1).between("!", "~") & F.substring(c, -1, 1).between("!", "~")
    return F.when(bare, c).otherwise(F.btrim(c, F.lit(WHITE_SPACE)))


def stripped(c: Column) -> Column:
    """V1: trimmed text, blank as null."""
    return F.nullif(trimmed(c), F.lit(""))


# The recognisers below read trimmed text; their public forms trim first. Jobs that ask
# several questions about a cell trim it once.


def number_of(text: Column) -> Column:
    return F.when(text.rlike(NUMBER), F.translate(text, NUMBER_NOISE + WHITE_SPACE, "").try_cast("double"))


def boolean_of(text: Column) -> Column:
    pairs = (F.lit(x) for word, value in BOOLEANS.items() for x in (word, value))
    return F.create_map(*pairs)[F.lower(text)]


def day_only_of(text: Column) -> Column:
    return text.rlike(ISO_DAY) | text.rlike(US_DATE)


def datetime_of(text: Column) -> Column:
    # The cast reads every accepted form but a fraction or an offset right after the minutes.
    full = F.when(F.substring(text, 17, 1) == ":", text).otherwise(
        F.concat(F.substring(text, 1, 16), F.lit(":00"), F.substring(text, 17, 64))
    )
    us = F.split(text, "/")
    us_day = F.concat_ws("-", F.get(us, F.lit(2)), F.lpad(F.get(us, F.lit(0)), 2, "0"), F.lpad(F.get(us, F.lit(1)), 2, "0"))
    # Every accepted form begins with a digit and has a dash after the year or a slash: other cells are spared the patterns.
    return F.when(
        F.substring(text, 1, 1).between("0", "9"),
        F.when(
            F.substring(text, 5, 1) == "-",
            F.when(text.rlike(ISO_DAY), text.try_cast("date").cast("timestamp"))
            .when(text.rlike(ISO_TIMESTAMP), F.date_trunc("MILLISECOND", full.try_cast("timestamp"))),
        ).when(text.contains("/"), F.when(text.rlike(US_DATE), us_day.try_cast("date").cast("timestamp"))),
    )


def to_number(c: Column) -> Column:
    """V2: "$1,200.50", "12%", "-4.5" as doubles; anything else null."""
    return number_of(trimmed(c))


def to_boolean(c: Column) -> Column:
    """V3: true/false/yes/no in any case, else null."""
    return boolean_of(trimmed(c))


def is_day_only(c: Column) -> Column:
    """V4: a plain date without a time part."""
    return day_only_of(trimmed(c))


def to_datetime(c: Column) -> Column:
    """V5: ISO days, ISO timestamps and US dates as UTC timestamps of ms precision."""
    return datetime_of(trimmed(c))


def iso_string(c: Column, dtype: T.DataType) -> Column:
    """V6: ``2025-04-01`` for dates, ``2025-09-18T16:05:43.000Z`` for timestamps."""
    if isinstance(dtype, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    return F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _double_text(c: Column) -> Column:
    """A double as written: no trailing ``.0``, no exponent between 1e-6 and 1e21."""
    text = c.cast("string")
    plain = F.regexp_replace(
        F.regexp_replace(text.try_cast(T.DecimalType(38, 22)).cast("string"), r"0+$", ""), r"\.$", ""
    )
    exponent = F.regexp_replace(F.regexp_replace(text, r"\.0E", "E"), r"E(-?)", "e$1")
    return (
        F.when(F.abs(c) < 1e18, F.when(c == F.floor(c), c.try_cast("bigint").cast("string"))
               .when(F.abs(c) >= 1e-6, F.when(text.contains("E"), plain).otherwise(text))
               .otherwise(exponent))
        .when(F.abs(c) < 1e21, text.try_cast(T.DecimalType(38, 0)).cast("string"))
        .otherwise(F.regexp_replace(exponent, r"e(\d)", "e+$1"))
    )


def display_string(c: Column, dtype: T.DataType) -> Column:
    """V7: the text identity of a value, used by filters, groups and profiles.

    A null stays null for every type, booleans included.
    """
    if is_temporal(dtype):
        return iso_string(c, dtype)
    if isinstance(dtype, T.DoubleType):
        return _double_text(c)
    if isinstance(dtype, T.FloatType):
        return _double_text(c.cast("string").cast("double"))
    return c.cast("string")


def category_key(c: Column, dtype: T.DataType) -> Column:
    """The group label of a value; booleans read Yes/No, nulls are dropped later."""
    if isinstance(dtype, T.BooleanType):
        return F.when(c.isNotNull(), F.when(c, F.lit("Yes")).otherwise(F.lit("No")))
    return display_string(c, dtype)
