"""Small column helpers shared by the expression modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BAR = "|"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a lambda variable so that ``body`` may use it many
    times while it is computed once per row. A plain column reference would be
    inlined by the optimizer and, inside a higher-order function, computed
    again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(text: Column) -> Column:
    """Lower case. The dotted capital I is mapped by hand: its full lower case
    is a letter plus a combining mark, which is no letter."""
    return F.lower(F.replace(text, F.lit("İ"), F.lit("i")))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def before_last_slash(tagged: Column) -> Column:
    return F.regexp_extract(tagged, r"(?s)^(.*)/", 1)


def after_last_slash(tagged: Column) -> Column:
    return F.substring_index(tagged, "/", -1)


def file_type(path: Column) -> Column:
    """Lower-cased extension, empty when there is none."""
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]*)$", 1))


def base64_encode(text: Column) -> Column:
    # base64() breaks lines every 76 characters; an identifier has none.
    return F.regexp_replace(F.base64(F.encode(text, "UTF-8")), "[\r\n]", "")


def base64_decode(text: Column) -> Column:
    return F.decode(F.unbase64(text), "UTF-8")
