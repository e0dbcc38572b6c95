"""Feature generation: polynomials, interactions, ratios, calendar parts, elapsed time, holidays."""

from __future__ import annotations

import datetime as dt
import math
from itertools import combinations, product

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.base import Estimator, Model, appended, chosen, columns_of, doubles, no_collision, non_empty
from quern.errors import Computation, InvalidInput
from quern.functions.exprs import fdiv, num, q
from quern.functions.exprs import product as times


class Terms(Model):
    def __init__(self, terms, columns):
        self.terms, self.columns = terms, columns

    def required(self):
        return [(c, T.DoubleType) for c in self.columns]

    def outputs(self, schema):
        out = []
        for name, powers in self.terms:
            parts = [q(c) if p == 1 else F.pow(q(c), num(p)) for c, p in zip(self.columns, powers, strict=True) if p]
            out.append((name, times(parts) if parts else num(1)))
        out += [(f.name, q(f.name)) for f in schema.fields if f.name not in self.columns]
        no_collision([n for n, _ in out])
        return out


class PolynomialFeatures(Estimator):
    """All products of double columns up to a degree, by total degree and then power vector; other columns follow.

    Names: the column, ``{c}^`` for its powers, columns joined by ``_`` and then ``_inter`` for products. They do not tell
    exponents apart, so a degree of 3 or more without ``interaction_only`` is refused for its equal names.
    """

    def __init__(self, degree: int = 2, interaction_only: bool = False, include_bias: bool = True):
        if degree < 1:
            raise InvalidInput("the degree must be at least 1")
        self.degree, self.interaction_only, self.include_bias = degree, interaction_only, include_bias

    def _fit(self, df, target=None):
        non_empty(df)
        cols = doubles(df)
        if "bias" in df.columns:
            raise InvalidInput("an input column is called 'bias'")
        n = len(cols)
        if self.interaction_only:
            powers = [tuple(int(i in c) for i in range(n)) for d in range(self.degree + 1) for c in combinations(range(n), d)]
        else:
            powers = sorted((p for p in product(range(self.degree + 1), repeat=n) if sum(p) <= self.degree), key=lambda p: (sum(p), p))
        terms = []
        for p in powers:
            used = [(c, k) for c, k in zip(cols, p, strict=True) if k]
            if not used:
                if self.include_bias:
                    terms.append(("bias", p))
                continue
            name = "_".join(c for c, _ in used)
            terms.append((name + ("_inter" if len(used) > 1 else "^" if used[0][1] > 1 else ""), p))
        if not terms:
            raise Computation("there is nothing to output")
        model = Terms(terms, cols)
        model.outputs(df.schema)
        return model


class Products(Model):
    def __init__(self, columns, self_products):
        self.columns, self.self_products = columns, self_products

    def required(self):
        return [(c, T.DoubleType) for c in self.columns]

    def outputs(self, schema):
        n = len(self.columns)
        pairs = [(i, j) for i in range(n) for j in range(i if self.self_products else i + 1, n)]
        return appended(schema, [(f"{self.columns[i]}_x_{self.columns[j]}", q(self.columns[i]) * q(self.columns[j])) for i, j in pairs])


class InteractionFeatures(Estimator):
    """``{a}_x_{b}`` for every pair of columns in input order."""

    def __init__(self, columns: list[str] | None = None, include_self_products: bool = False):
        self.columns, self.include_self_products = columns, include_self_products

    def _fit(self, df, target=None):
        cols = chosen(df, self.columns, T.DoubleType)
        non_empty(df)
        model = Products(cols, self.include_self_products)
        model.outputs(df.schema)
        return model


class Quotients(Model):
    def __init__(self, columns, reciprocal, epsilon):
        self.columns, self.reciprocal, self.epsilon = columns, reciprocal, epsilon

    def required(self):
        return [(c, T.DoubleType) for c in self.columns]

    def ratio(self, a: str, b: str) -> Column:
        if not self.epsilon:
            return fdiv(q(a), q(b))
        below = (q(b) < 0) | (q(b).cast("string") == "-0.0")
        return fdiv(q(a), q(b) + F.when(below, num(-self.epsilon)).otherwise(num(self.epsilon)))

    def outputs(self, schema):
        n = len(self.columns)
        pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
        new = []
        for i, j in pairs:
            a, b = self.columns[i], self.columns[j]
            new.append((f"{a}_div_{b}", self.ratio(a, b)))
            if self.reciprocal:
                new.append((f"{b}_div_{a}", self.ratio(b, a)))
        return appended(schema, new)


class RatioFeatures(Estimator):
    """``{a}_div_{b}`` = a / (b + epsilon with b's sign) for sorted distinct columns; epsilon 0 is IEEE division."""

    def __init__(self, columns: list[str] | None = None, include_reciprocal: bool = False, epsilon: float = 1e-12):
        self.columns, self.include_reciprocal, self.epsilon = columns, include_reciprocal, epsilon

    def _fit(self, df, target=None):
        if not math.isfinite(self.epsilon) or self.epsilon < 0:
            raise InvalidInput("epsilon must be finite and not negative")
        cols = sorted(set(chosen(df, self.columns or None, T.DoubleType)))
        non_empty(df)
        model = Quotients(cols, self.include_reciprocal, self.epsilon)
        model.outputs(df.schema)
        return model


DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def date_columns(df, columns) -> list[str]:
    cols = columns_of(df.schema, *DATES) if columns is None else list(columns)
    if not cols:
        raise InvalidInput("no date or timestamp column")
    for c in cols:
        if c not in df.columns:
            raise InvalidInput(f"column '{c}' is missing")
        if not isinstance(df.schema[c].dataType, DATES):
            raise InvalidInput(f"column '{c}' is {df.schema[c].dataType.simpleString()}, expected a date or timestamp")
    return cols


PARTS = {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second,
    "weekday": F.weekday, "day_of_year": F.dayofyear, "week_of_year": F.weekofyear, "quarter": F.quarter,
}


class DateModel(Model):
    def __init__(self, kinds):
        self.kinds = kinds

    def check(self, schema):
        for c, kind in self.kinds.items():
            if c not in schema.names:
                raise InvalidInput(f"column '{c}' is missing")
            if schema[c].dataType != kind:
                raise InvalidInput(f"column '{c}' is {schema[c].dataType.simpleString()}, it was {kind.simpleString()} when fitted")

    def _guess(self, names):
        return T.StructType([T.StructField(n, self.kinds.get(n, T.DoubleType())) for n in names])


class Calendar(DateModel):
    def __init__(self, kinds, parts):
        super().__init__(kinds)
        self.parts = parts

    def outputs(self, schema):
        new = []
        for c, kind in self.kinds.items():
            for p in self.parts:
                if p == "is_weekend":
                    v = F.when(q(c).isNull(), None).when(F.weekday(q(c)) >= 5, 1.0).otherwise(0.0)
                elif p in ("hour", "minute", "second") and isinstance(kind, T.DateType):
                    v = F.when(q(c).isNotNull(), F.lit(0))
                else:
                    v = PARTS[p](q(c))
                new.append((f"{c}_{p}", v))
        return appended(schema, new)


class DatetimeFeatures(Estimator):
    """Calendar parts ``{c}_{part}`` (integers; ``is_weekend`` a double; weekday 0 is Monday, weeks are ISO weeks)."""

    def __init__(self, columns: list[str] | None = None, components: tuple[str, ...] = ("year", "month", "day")):
        bad = [p for p in components if p not in PARTS and p != "is_weekend"]
        if bad or not components:
            raise InvalidInput(f"unknown components {bad}")
        self.columns, self.components = columns, tuple(components)

    def _fit(self, df, target=None):
        cols = date_columns(df, self.columns)
        non_empty(df)
        model = Calendar({c: df.schema[c].dataType for c in cols}, self.components)
        model.outputs(df.schema)
        return model


SECONDS = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400, "weeks": 604800}


def micros(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long") * F.lit(86_400_000_000)
    if isinstance(kind, T.TimestampNTZType):  # read as UTC, whatever the session's zone
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)
    return F.unix_micros(c)


class Elapsed(DateModel):
    def __init__(self, kinds, unit, since):
        super().__init__(kinds)
        self.unit, self.since = unit, since

    def outputs(self, schema):
        new = []
        for c, kind in self.kinds.items():
            if isinstance(kind, T.DateType):
                days = F.unix_date(q(c)) - F.lit(self.since[c] // 86_400_000_000)
                v = days.cast("double") * num(86400 / SECONDS[self.unit])
            else:
                v = (micros(q(c), kind) - F.lit(self.since[c])).cast("double") / num(1e6 * SECONDS[self.unit])
            new.append((f"{c}_since_{self.unit}", v))
        return appended(schema, new)


class TimeSince(Estimator):
    """``{c}_since_{unit}``: signed time since a fixed instant (a datetime or microseconds), or the column's ``min`` or ``max``."""

    def __init__(self, columns: list[str] | None = None, unit: str = "days", reference: str | int | dt.datetime = "min"):
        if unit not in SECONDS:
            raise InvalidInput(f"unknown unit '{unit}'")
        self.columns, self.unit, self.reference = columns, unit, reference

    def _fit(self, df, target=None):
        cols = date_columns(df, self.columns)
        non_empty(df)
        kinds = {c: df.schema[c].dataType for c in cols}
        if self.reference in ("min", "max"):
            f = F.min if self.reference == "min" else F.max
            row = df.agg(*[f(micros(q(c), kinds[c])).alias(f"r{i}") for i, c in enumerate(cols)]).first()
            since = {c: row[f"r{i}"] for i, c in enumerate(cols)}
            for c in cols:
                if since[c] is None:
                    raise InvalidInput(f"column '{c}' has no value to measure from")
        else:
            at = self.reference
            if isinstance(at, dt.datetime):
                at = at if at.tzinfo else at.replace(tzinfo=dt.timezone.utc)
                at = (at - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)
            since = dict.fromkeys(cols, int(at))
        model = Elapsed(kinds, self.unit, since)
        model.outputs(df.schema)
        return model


# Rules: ("fixed", month, day), ("nth", month, weekday with Monday 0, n; -1 is the last), ("easter", days after it);
# then the first and the last year.
ALWAYS = (-(10**9), 10**9)
_JP = [(1, 1), (2, 11), (4, 29), (5, 3), (5, 4), (5, 5), (11, 3), (11, 23)]
HOLIDAYS: dict[str, list[tuple]] = {
    "US": [
        (("fixed", 1, 1), *ALWAYS), (("nth", 1, 0, 3), 1986, ALWAYS[1]), (("nth", 2, 0, 3), *ALWAYS), (("nth", 5, 0, -1), *ALWAYS),
        (("fixed", 6, 19), 2021, ALWAYS[1]), (("fixed", 7, 4), *ALWAYS), (("nth", 9, 0, 1), *ALWAYS), (("nth", 10, 0, 2), *ALWAYS),
        (("fixed", 11, 11), *ALWAYS), (("nth", 11, 3, 4), *ALWAYS), (("fixed", 12, 25), *ALWAYS),
    ],
    "GB": [
        (("fixed", 1, 1), 1974, ALWAYS[1]), (("easter", -2), *ALWAYS), (("easter", 1), *ALWAYS), (("nth", 5, 0, 1), 1978, ALWAYS[1]),
        (("nth", 5, 0, -1), *ALWAYS), (("nth", 8, 0, -1), *ALWAYS), (("fixed", 12, 25), *ALWAYS), (("fixed", 12, 26), *ALWAYS),
    ],
    "DE": [(("fixed", m, d), *ALWAYS) for m, d in [(1, 1), (5, 1), (12, 25), (12, 26)]]
    + [(("easter", d), *ALWAYS) for d in (-2, 1, 39, 50)] + [(("fixed", 10, 3), 1990, ALWAYS[1])],
    "FR": [(("fixed", m, d), *ALWAYS) for m, d in [(1, 1), (5, 1), (5, 8), (7, 14), (8, 15), (11, 1), (11, 11), (12, 25)]]
    + [(("easter", d), *ALWAYS) for d in (1, 39, 50)],
    "JP": [(("fixed", m, d), *ALWAYS) for m, d in _JP]
    + [(("nth", 1, 0, 2), *ALWAYS), (("nth", 7, 0, 3), *ALWAYS), (("nth", 9, 0, 3), *ALWAYS), (("nth", 10, 0, 2), *ALWAYS)]
    + [(("fixed", 2, 23), 2020, ALWAYS[1]), (("fixed", 8, 11), 2016, ALWAYS[1]), (("fixed", 12, 23), 1989, 2018)],
    "IN": [(("fixed", 1, 26), *ALWAYS), (("easter", -2), *ALWAYS), (("fixed", 8, 15), *ALWAYS), (("fixed", 10, 2), *ALWAYS), (("fixed", 12, 25), *ALWAYS)],
}


def easter_day(year: Column) -> tuple[Column, Column]:
    """Month and day of Gregorian Easter Sunday, for any year."""
    def quot(x, y):
        return F.floor(x / y).cast("long")

    y = year.cast("long")
    golden = F.pmod(y, F.lit(19))
    century, rest = quot(y, 100), F.pmod(y, F.lit(100))
    leap, off = quot(century, 4), F.pmod(century, F.lit(4))
    drift = quot(century + 8, 25)
    moon = F.pmod(golden * 19 + century - leap - quot(century - drift + 1, 3) + 15, F.lit(30))
    week = F.pmod(F.lit(32) + off * 2 + quot(rest, 4) * 2 - moon - F.pmod(rest, F.lit(4)), F.lit(7))
    late = quot(golden + moon * 11 + week * 22, 451)
    total = moon + week - late * 7 + 114
    return quot(total, 31), F.pmod(total, F.lit(31)) + 1


def is_holiday(day: Column, country: str) -> Column:
    """Whether a date is one of the country's fixed, weekday or Easter holidays, by arithmetic on the date (any year)."""
    year, month, dom, wd = F.year(day), F.month(day), F.dayofmonth(day), F.weekday(day)
    easter = F.make_date(year, *(x.cast("int") for x in easter_day(year)))
    gap = F.datediff(day, easter)
    tests = []
    for rule, since, until in HOLIDAYS[country]:
        if rule[0] == "fixed":
            hit = (month == rule[1]) & (dom == rule[2])
        elif rule[0] == "easter":
            hit = gap == rule[1]
        elif rule[3] > 0:
            hit = (month == rule[1]) & (wd == rule[2]) & (dom > 7 * (rule[3] - 1)) & (dom <= 7 * rule[3])
        else:
            hit = (month == rule[1]) & (wd == rule[2]) & (F.month(F.date_add(day, 7)) != rule[1])
        if (since, until) != ALWAYS:
            hit = hit & (year >= max(since, 0)) & (year <= min(until, 99999))
        tests.append(hit)
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


class Holidays(DateModel):
    def __init__(self, kinds, country):
        super().__init__(kinds)
        self.country = country

    def outputs(self, schema):
        return appended(schema, [(f"{c}_is_holiday", F.when(q(c).isNull(), None).when(is_holiday(q(c).cast("date"), self.country), 1.0).otherwise(0.0)) for c in self.kinds])


class HolidayEncoder(Estimator):
    """``{c}_is_holiday`` for a country's public holidays (US, GB, DE, FR, JP, IN); no substitute or lunar days."""

    def __init__(self, columns: list[str] | None = None, country: str = "US"):
        if country not in HOLIDAYS:
            raise InvalidInput(f"unknown country '{country}'")
        self.columns, self.country = columns, country

    def _fit(self, df, target=None):
        cols = date_columns(df, self.columns)
        non_empty(df)
        model = Holidays({c: df.schema[c].dataType for c in cols}, self.country)
        model.outputs(df.schema)
        return model
