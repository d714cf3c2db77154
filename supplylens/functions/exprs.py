"""The functions of calculated columns, as Column builders with spreadsheet coercion.

Arguments are Columns, or plain Python values, which become literals. Text counts as a
number where a number is needed; what cannot be read as one counts as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from supplylens.functions.parse import parse_date, parse_number, parse_timestamp
from supplylens.functions.text import clean_text, comparable_text, let


class Expressions:
    """Builders bound to one DataFrame's schema, whose column types steer the coercion."""

    def __init__(self, df: DataFrame):
        self.df = df

    def _column(self, value) -> Column:
        return value if isinstance(value, Column) else F.lit(value)

    def _type(self, value) -> T.DataType:
        return self.df.select(self._column(value).alias("x")).schema["x"].dataType

    def _parsed(self, value) -> Column:
        kind, column = self._type(value), self._column(value)
        if isinstance(kind, T.NumericType):
            number = column.cast("double")
            return F.when(~F.isnan(number), number)
        if isinstance(kind, T.StringType):
            return parse_number(column)
        return F.lit(None).cast("double")

    def _number(self, value) -> Column:
        return F.coalesce(self._parsed(value), F.lit(0.0))

    def _text(self, value) -> Column:
        """Text as a spreadsheet shows it: whole doubles without '.0'."""
        text = self._column(value).cast("string")
        if isinstance(self._type(value), (T.DoubleType, T.FloatType)):
            text = F.regexp_replace(text, r"\.0$", "")
        return text

    def truthy(self, value) -> Column:
        kind, column = self._type(value), self._column(value)
        if isinstance(kind, T.BooleanType):
            return F.coalesce(column, F.lit(False))
        if isinstance(kind, T.NumericType):
            return F.coalesce(column != 0, F.lit(False))
        if isinstance(kind, T.StringType):
            no = comparable_text(column).isin("0", "false", "falsz", "nie", "no")
            return F.coalesce((column != "") & ~no, F.lit(False))
        return column.isNotNull()

    def if_(self, condition, then, otherwise=None) -> Column:
        return F.when(self.truthy(condition), self._column(then)).otherwise(self._column(otherwise))

    def iferror(self, value, fallback=None) -> Column:
        column = self._column(value)
        if isinstance(self._type(value), (T.DoubleType, T.FloatType)):
            column = F.when(~F.isnan(column), column)
        return F.coalesce(column, self._column(fallback))

    def round(self, value, digits: int = 0) -> Column:
        number = self._number(value)
        # BigDecimal text of the double, so that 1.005 rounds to 1.01 half away from zero
        return F.round(number, int(digits))

    def abs(self, value) -> Column:
        return F.abs(self._number(value))

    def coalesce(self, *values) -> Column:
        return F.coalesce(*[
            F.nullif(self._column(v), F.lit("")) if isinstance(self._type(v), T.StringType) else self._column(v)
            for v in values])

    def concat(self, *values) -> Column:
        return F.concat_ws("", *[self._text(v) for v in values])

    def upper(self, value) -> Column:
        return F.upper(clean_text(self._text(value)))

    def lower(self, value) -> Column:
        return F.lower(clean_text(self._text(value)))

    def len(self, value) -> Column:
        return F.coalesce(F.length(self._text(value)), F.lit(0))

    def min(self, *values) -> Column:
        numbers = [self._parsed(v) for v in values]
        return F.least(*numbers) if len(numbers) > 1 else numbers[0]

    def max(self, *values) -> Column:
        numbers = [self._parsed(v) for v in values]
        return F.greatest(*numbers) if len(numbers) > 1 else numbers[0]

    def isblank(self, value) -> Column:
        column = self._column(value)
        if isinstance(self._type(value), T.StringType):
            return column.isNull() | (column == "")
        return column.isNull()

    def _stamp(self, value) -> Column:
        kind, column = self._type(value), self._column(value)
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return column.cast("timestamp_ntz")
        return parse_timestamp(self._text(value))

    def date_diff_days(self, left, right) -> Column:
        gap = F.timestamp_diff("SECOND", self._stamp(right), self._stamp(left))
        return F.round(gap / 86400).cast("bigint")

    def add(self, left, right) -> Column:
        if any(isinstance(self._type(v), T.StringType) for v in (left, right)):
            return self.concat(left, right)
        return self._number(left) + self._number(right)

    def sub(self, left, right) -> Column:
        return self._number(left) - self._number(right)

    def mul(self, left, right) -> Column:
        return self._number(left) * self._number(right)

    def div(self, left, right) -> Column:
        return F.try_divide(self._number(left), self._number(right))

    def pow(self, left, right) -> Column:
        return F.pow(self._number(left), self._number(right))

    def neg(self, value) -> Column:
        return -self._number(value)

    def compare(self, left, op: str, right) -> Column:
        """Compare as numbers where both sides read as numbers, else dates, else folded text."""
        tests = {"=": lambda a, b: a == b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
                 ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
                 "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}
        test, differ = tests[op], F.lit(op == "!=")
        kinds = self._type(left), self._type(right)
        stamped = (T.DateType, T.TimestampType, T.TimestampNTZType)
        numbers = self._parsed(left), self._parsed(right)
        if any(isinstance(k, stamped) for k in kinds):
            return test(self._stamp(left), self._stamp(right))
        if any(isinstance(k, T.NumericType) for k in kinds):
            return F.coalesce(test(*numbers), differ)
        sides = [F.struct(self._parsed(v).alias("n"), self._stamp(v).alias("d"),
                          comparable_text(self._text(v)).alias("t")) for v in (left, right)]

        def decide(a: Column, b: Column) -> Column:
            plain = a["n"].isNull() & b["n"].isNull()
            return (F.when(a["n"].isNotNull() & b["n"].isNotNull(), test(a["n"], b["n"]))
                    .when(plain & a["d"].isNotNull() & b["d"].isNotNull(), test(a["d"], b["d"]))
                    .when(plain & a["d"].isNull() & b["d"].isNull(), test(a["t"], b["t"]))
                    .otherwise(differ))

        return let(F.struct(sides[0].alias("a"), sides[1].alias("b")), lambda p: decide(p["a"], p["b"]))

    def and_(self, left, right) -> Column:
        return self.truthy(left) & self.truthy(right)

    def or_(self, left, right) -> Column:
        return self.truthy(left) | self.truthy(right)

    def not_(self, value) -> Column:
        return ~self.truthy(value)


def cast_result(column: Column, kind: str) -> Column:
    """A calculated value in its declared type; what does not fit becomes NULL."""
    text = column.cast("string")
    if kind == "number":
        return parse_number(text)
    if kind == "date":
        return parse_date(text)
    if kind == "boolean":
        return column.try_cast("boolean")
    return text


def dependency_order(needs: dict[str, list[str]]) -> list[str]:
    """Calculated columns, each after those it reads; a cycle is an error."""
    done: list[str] = []
    waiting = dict(needs)
    while waiting:
        ready = [name for name, reads in waiting.items()
                 if not any(other in waiting for other in reads)]
        if not ready:
            raise ValueError(f"calculated columns depend on each other: {sorted(waiting)}")
        done.extend(ready)
        for name in ready:
            del waiting[name]
    return done


def calculate(df: DataFrame, columns: dict[str, tuple[list[str], object, str]]) -> DataFrame:
    """Add calculated columns: name -> (columns read, builder, declared type).

    ``builder(expressions)`` returns the Column. The order of evaluation follows the
    dependencies, and a cycle is refused before anything is added.
    """
    for name in dependency_order({n: spec[0] for n, spec in columns.items()}):
        _, builder, kind = columns[name]
        column = builder(Expressions(df))
        already = {"number": T.NumericType, "date": T.DateType, "boolean": T.BooleanType,
                   "text": T.StringType}[kind]
        fits = isinstance(df.select(column.alias("x")).schema["x"].dataType, already)
        df = df.withColumn(name, column if fits else cast_result(column, kind))
    return df
