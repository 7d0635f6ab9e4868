"""Arithmetic and units."""

from __future__ import annotations

import operator
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bind import let

#: Binary signs with their strength; a power binds to the right and before a sign in front of it.
_STRENGTH = {"+": 1, "-": 1, "*": 2, "/": 2, "//": 2, "%": 2, "**": 4}
_APPLY = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv, "//": operator.floordiv, "%": operator.mod, "**": operator.pow}
_TOKENS = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|(\*\*|//|[-+*/%()]))")
#: Fixed value: the largest exponent.
LARGEST_EXPONENT = 64
#: The units with their kind and their size in its base unit.
UNITS = (
    ("mm", "length", 0.001), ("cm", "length", 0.01), ("m", "length", 1.0), ("km", "length", 1000.0), ("inch", "length", 0.0254), ("ft", "length", 0.3048), ("mile", "length", 1609.344),
    ("mg", "mass", 1e-6), ("g", "mass", 0.001), ("kg", "mass", 1.0), ("lb", "mass", 0.45359237), ("oz", "mass", 0.028349523125),
    ("s", "time", 1.0), ("min", "time", 60.0), ("hour", "time", 3600.0), ("day", "time", 86400.0),
)


def parsed(text: str, number, signed, joined):
    """An arithmetic text put together by three functions: of a number's text, of a sign and a value, of a sign and two values.

    Two stacks over the tokens: a sign waits until a weaker one, or a closing bracket, follows. ValueError where it isn't
    arithmetic.
    """
    values: list = []
    signs: list[str] = []
    wants_value, at, text = True, 0, text.rstrip()

    def apply():
        sign, b = signs.pop(), values.pop()
        values.append(signed(sign[1], b) if sign[0] == "u" else joined(sign, values.pop(), b))

    strength = lambda sign: 3 if sign[0] == "u" else _STRENGTH[sign]
    while at < len(text):
        token = _TOKENS.match(text, at)
        if token is None:
            raise ValueError("not arithmetic")
        at, (digits, sign) = token.end(), token.groups()
        if digits is not None and wants_value:
            values.append(number(digits))
            wants_value = False
        elif sign == "(" and wants_value:
            signs.append(sign)
        elif sign in ("-", "+") and wants_value:
            signs.append("u" + sign)
        elif sign == ")" and not wants_value and "(" in signs:
            while signs[-1] != "(":
                apply()
            signs.pop()
        elif sign in _STRENGTH and not wants_value:
            while signs and signs[-1] != "(" and (strength(signs[-1]) > _STRENGTH[sign] or (strength(signs[-1]) == _STRENGTH[sign] and sign != "**")):
                apply()
            signs.append(sign)
            wants_value = True
        else:
            raise ValueError("not arithmetic")
    if wants_value or "(" in signs:
        raise ValueError("not arithmetic")
    while signs:
        apply()
    return values[0]


def _result(text: str) -> float | int:
    def joined(sign, a, b):
        if sign == "**" and abs(b) > LARGEST_EXPONENT:
            raise ValueError("exponent too large")
        return _APPLY[sign](a, b)

    return parsed(text, lambda d: int(d) if d.isdigit() else float(d), lambda sign, a: -a if sign == "-" else a, joined)


@F.pandas_udf(T.StringType())
def expression_shape(text: pd.Series) -> pd.Series:
    """An arithmetic text with a ``c`` for each number and brackets around every operation; ``?`` for anything else.

    Both signs in front of a value are written as a minus.
    """

    def shape(t):
        try:
            return parsed(t, lambda _: "c", lambda _, a: f"(-{a})", lambda sign, a, b: f"({a}{sign}{b})")
        except ValueError:
            return "?"

    return text.map(shape, na_action="ignore")


@F.pandas_udf(T.StringType())
def calculated(expression: pd.Series) -> pd.Series:
    """The result of each expression, or a text that begins with ``error:``."""

    def one(text):
        if text is None:
            return None
        try:
            value = _result(text)
            whole = isinstance(value, int) or value.is_integer()
            return str(int(value)) if whole else f"{value:.6g}"
        except ZeroDivisionError:
            return "error: division by zero"
        except (ValueError, TypeError, OverflowError, AttributeError) as e:
            return f"error: {e}"

    return expression.map(one)


def written(x: Column) -> Column:
    """A number as the tools write it: whole ones without a point, others with six digits at most.

    A number whose shortest form has seven digits, the last a five, is rounded by that form, to an even digit.
    """

    def shown(x: Column) -> Column:
        places = F.greatest(F.lit(0), F.least(F.lit(9), 5 - F.floor(F.log10(F.abs(x)))))
        even = F.when(F.abs(x).between(1e-4, 1e6), F.get(F.array(*(F.bround(x, i) for i in range(10))), places.cast("int"))).otherwise(x)
        short = F.regexp_replace(F.regexp_replace(F.format_string("%.6g", even), r"(\.\d*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")
        return F.when(x == F.floor(x), x.cast("decimal(38,0)").cast("string")).when(x.isNotNull(), short)

    return let(x, shown)


def arithmetic(expression: Column) -> Column:
    """The result of sums and products of numbers without brackets, as ``calculated`` writes it, without Python on the workers.

    Anything else, and a division by zero, is null: a fold over the tokens adds up a sum and the product that is still open.
    """
    tokens = F.regexp_extract_all(expression, F.lit(r"\*\*|//|[-+*/%]|[^-+*/%\s]+"), F.lit(0))
    start = F.struct(F.lit("").alias("sign"), F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("product"), F.lit(False).alias("minus"), F.lit(True).alias("good"))
    open_sum = lambda a: a["sum"] + F.when(a["minus"], -a["product"]).otherwise(a["product"])

    def step(acc: Column, token: Column) -> Column:
        sign, product = acc["sign"], acc["product"]
        is_sign = token.rlike(r"^(\*\*|//|[-+*/%])$")
        lone = (sign == "") & product.isNull()
        ends = ~is_sign & sign.isin("+", "-")

        def taken(x: Column) -> Column:
            joined = F.when(lone | sign.isin("+", "-"), x).when(sign == "*", product * x).when(x == 0, F.lit(None)).when(sign == "/", product / x).when(sign == "//", F.floor(product / x).cast("double")).when(sign == "%", product - x * F.floor(product / x))
            return let(joined, lambda joined: F.struct(F.when(is_sign, token).otherwise("").alias("sign"), F.when(ends, open_sum(acc)).otherwise(acc["sum"]).alias("sum"), F.when(is_sign, product).otherwise(joined).alias("product"), F.when(ends, sign == "-").otherwise(acc["minus"]).alias("minus"), (acc["good"] & F.coalesce(F.when(is_sign, (sign == "") & product.isNotNull() & (token != "**")).otherwise(joined.isNotNull() & (lone | (sign != ""))), F.lit(False))).alias("good")))

        return let(F.when(token.rlike(r"^(\d+\.?\d*|\.\d+)([eE]\d+)?$"), token.cast("double")), taken)

    done = F.aggregate(tokens, start, step, lambda a: F.when(a["good"] & (a["sign"] == ""), open_sum(a)))
    return written(done)


def units(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(UNITS), "unit string, kind string, size double")


def converted(df: DataFrame, value: str, source: str, target: str) -> DataFrame:
    """``df`` with ``converted`` and ``problem``: unknown units and kinds that differ give a problem and no value."""
    dim = units(df.sparkSession)
    a = F.broadcast(dim.toDF("_a", "_kind_a", "_size_a"))
    b = F.broadcast(dim.toDF("_b", "_kind_b", "_size_b"))
    out = df.join(a, F.lower(F.trim(source)) == F.col("_a"), "left").join(b, F.lower(F.trim(target)) == F.col("_b"), "left")
    problem = F.when(F.col("_a").isNull() | F.col("_b").isNull(), "unknown unit").when(F.col("_kind_a") != F.col("_kind_b"), "different kinds")
    return out.withColumn("problem", problem).withColumn("converted", F.when(F.col("problem").isNull(), F.col(value) * F.col("_size_a") / F.col("_size_b"))).drop("_a", "_b", "_kind_a", "_kind_b", "_size_a", "_size_b")


def wrong_units(unit: Column) -> Column:
    """Other units of the same kind, in the table's order."""
    table = F.array(*(F.struct(F.lit(u).alias("unit"), F.lit(k).alias("kind")) for u, k, _ in UNITS))
    kind = F.try_element_at(F.create_map(*(F.lit(x) for u, k, _ in UNITS for x in (u, k))), unit)
    return F.transform(F.filter(table, lambda x: (x["kind"] == kind) & (x["unit"] != unit)), lambda x: x["unit"])
