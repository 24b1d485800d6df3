"""Keys at given ranks of a global order, and NTILE from them, without sorting the rows.

An order's key is turned into *digits*: columns of whole numbers that compare, one after the other, as the key does (a
descending column's are complemented, NULL has a digit of its own, a string is read seven bytes at a time). The key at a
rank is then found from the top digit down. Each pass counts the rows of what is still in question by ``CELLS`` equal cells
of its digit - a partial aggregate, so a task sends at most ``CELLS`` numbers a rank - and descends into the cell that
holds the rank. When a cell holds at most ``FETCHED`` rows their keys are read instead. All ranks of all orders share
the passes: the scores of one table take one set of bounds.

What reaches the driver is bounded by ranks x ``CELLS`` counts and ranks x ``FETCHED`` keys, whatever the rows are. A value held by
97 % of the rows costs passes over the tie-breaker, no larger task. Rows are read once a pass, so give stored ones.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells that an interval is cut into by a pass (a power of two), and rows of a cell that are read rather than counted further.
CELLS, FETCHED = 1024, 256

#: (column name, ascending): NULLs come first ascending, last descending, as in Spark and MySQL.
Order = Sequence[tuple[str, bool]]

_BYTES = 7                       # of a string in one digit: 257 ** 7 < 2 ** 63
_HALF = 10 ** 18                 # whole parts of more digits are split here


def _whole(df: DataFrame, name: str, longest: Mapping[str, int]) -> list[Column]:
    """Whole numbers that order the column's non-null values."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.BooleanType | T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return [c.cast("long")]
    if isinstance(kind, T.DateType):
        return [F.unix_date(c).cast("long")]
    if isinstance(kind, T.TimestampNTZType):
        passed = f"(`{name}` - TIMESTAMP_NTZ'1970-01-01 00:00:00')"      # a day-time interval: no time zone
        return [F.expr(f"86400000000 * CAST(extract(DAY FROM {passed}) AS BIGINT) + 3600000000 * CAST(extract(HOUR FROM {passed}) AS BIGINT)"
                       f" + 60000000 * CAST(extract(MINUTE FROM {passed}) AS BIGINT) + CAST(1000000 * extract(SECOND FROM {passed}) AS BIGINT)")]
    if isinstance(kind, T.TimestampType):
        return [F.unix_micros(c)]
    if isinstance(kind, T.DecimalType) and kind.scale <= 18:
        if kind.precision <= 18:
            return [(c * F.lit(10 ** kind.scale)).cast("long")]
        whole = F.floor(c).cast("decimal(38,0)")
        high = F.floor(whole / F.lit(_HALF)).cast("long")
        parts = [high, (whole - high.cast("decimal(38,0)") * F.lit(_HALF)).cast("long")] if kind.precision - kind.scale > 18 else [whole.cast("long")]
        return [*parts, ((c - F.floor(c)) * F.lit(10 ** kind.scale)).cast("long")]
    if isinstance(kind, T.StringType | T.BinaryType):
        raw = F.hex(c.cast("binary"))
        byte = lambda i: F.when(F.length(raw) > 2 * i, F.conv(F.substring(raw, 2 * i + 1, 2), 16, 10).cast("long") + 1).otherwise(0)
        return [sum((byte(at + i) * F.lit(257 ** (_BYTES - 1 - i)) for i in range(_BYTES)), F.lit(0).cast("long"))
                for at in range(0, max(1, longest[name]), _BYTES)]
    raise TypeError(f"no ranks over {name}: {kind.simpleString()}")


def _digits(df: DataFrame, order: Order, longest: Mapping[str, int]) -> list[Column]:
    out = []
    for name, ascending in order:
        turned = (lambda d: d) if ascending else F.bitwise_not
        if df.schema[name].nullable:
            out.append(turned(F.col(name).isNotNull().cast("long")))
        out += [turned(F.coalesce(d, F.lit(0).cast("long"))) for d in _whole(df, name, longest)]
    return out


@dataclass
class _Sought:
    """A rank (1-based) among the rows whose first digits are ``fixed`` and whose next one lies in [low, high]."""

    order: str
    rank: int
    rows: int
    fixed: tuple[int, ...]
    low: int
    high: int

    @property
    def place(self) -> tuple:
        return self.order, self.fixed, self.low, self.high


def _in(digits: list[str], fixed: tuple[int, ...], low: int, high: int) -> Column:
    cond = F.col(digits[len(fixed)]).between(low, high)
    for d, v in zip(digits, fixed):
        cond = (F.col(d) == v) & cond
    return cond


def keys_at(df: DataFrame, orders: Mapping[str, Sequence[Column]], ranks: Mapping[str, Sequence[int]]) -> dict[str, list[tuple[int, ...]]]:
    """Per order, the digits of the rows at its ranks (1 to the number of rows); ``orders`` holds each order's digits."""
    digits = {o: [f"_{i}_{j}" for j in range(len(cols))] for i, (o, cols) in enumerate(orders.items())}
    coded = df.select(*[c.alias(d) for o, cols in orders.items() for d, c in zip(digits[o], cols)])
    names = coded.columns
    ends = coded.agg(F.count(F.lit(1)), *[f(d) for d in names for f in (F.min, F.max)]).first()
    spans = {d: (ends[2 * i + 1], ends[2 * i + 2]) for i, d in enumerate(names)}
    sought = [_Sought(o, r, ends[0], (), *spans[digits[o][0]]) for o in orders for r in ranks[o]]
    while True:
        for s in sought:                                   # digits with one value left are settled
            while s.low == s.high and len(s.fixed) + 1 < len(digits[s.order]):
                s.fixed += (s.low,)
                s.low, s.high = spans[digits[s.order][len(s.fixed)]]
        wide = [s for s in sought if s.rows > FETCHED and s.low < s.high]
        if not wide:
            break
        places = list(dict.fromkeys(s.place for s in wide))
        shifts = {p: next(n for n in range(64) if (p[3] >> n) - (p[2] >> n) < CELLS) for p in places}
        code = lambda i, p: F.lit(i * CELLS).cast("long") + F.shiftright(F.col(digits[p[0]][len(p[1])]), shifts[p]) - F.lit(p[2] >> shifts[p])
        counts: dict[int, int] = dict(_each_order(coded, digits, places, code).groupBy("v").agg(F.count(F.lit(1))).collect())   # CELLS a place at most
        for s in wide:
            i, shift = places.index(s.place), shifts[s.place]
            base = s.low >> shift
            for cell in range(CELLS):
                n = counts.get(i * CELLS + cell, 0)
                if s.rank <= n:
                    break
                s.rank -= n
            s.rows, s.low, s.high = n, max(s.low, (base + cell) << shift), min(s.high, ((base + cell + 1) << shift) - 1)
    # what is left: few rows each (read), or equal keys
    few = [s for s in sought if s.low < s.high]
    places = list(dict.fromkeys(s.place for s in few))
    found: dict[int, list] = {i: [] for i in range(len(places))}
    if places:
        keys = lambda i, p: F.struct(F.lit(i).alias("place"), F.array(*digits[p[0]]).alias("key"))
        for r in _each_order(coded, digits, places, keys).select("v.place", "v.key").collect():     # FETCHED a place at most
            found[r["place"]].append(tuple(r["key"]))
    out: dict[str, list[tuple[int, ...]]] = {o: [] for o in orders}
    for s in sought:
        out[s.order].append(sorted(found[places.index(s.place)])[s.rank - 1] if s.low < s.high else (*s.fixed, s.low))
    return out


def _each_order(coded: DataFrame, digits: dict[str, list[str]], places: list[tuple], value) -> DataFrame:
    """(v): ``value(i, place)`` for each order and row that lies in one of the places, which don't overlap within an order."""
    cases = []
    for o in dict.fromkeys(p[0] for p in places):
        case: Column | None = None
        for i, p in enumerate(places):
            if p[0] == o:
                hit, v = _in(digits[o], *p[1:]), value(i, p)
                case = F.when(hit, v) if case is None else case.when(hit, v)
        cases.append(case)
    return coded.select(F.explode(F.array(*cases)).alias("v")).filter("v is not null")


def ntiles(df: DataFrame, tiles: Mapping[str, tuple[int, Order]]) -> DataFrame:
    """``df`` with a column for each of ``tiles``: name -> (n, order) adds SQL ``NTILE(n) OVER (ORDER BY order)``.

    Orders must be unique (end them with a key). Columns may be whole numbers, dates, timestamps, decimals, strings or booleans. The first
    (rows mod n) tiles hold one row more; with fewer rows than ``n`` the last tiles stay empty. All bounds are found together, then a row
    is compared with the at most n - 1 of each order: no shuffle, no sort.
    """
    strings = {c for _, order in tiles.values() for c, _ in order if isinstance(df.schema[c].dataType, T.StringType | T.BinaryType)}
    first = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.max(F.octet_length(c)).alias(c) for c in sorted(strings)]).first()
    rows, longest = first["_rows"], {c: first[c] or 0 for c in strings}
    orders = {name: _digits(df, order, longest) for name, (_, order) in tiles.items()}
    ends = {name: [t * (rows // n) + min(t, rows % n) for t in range(1, n)] for name, (n, _) in tiles.items()}
    keys = keys_at(df, orders, ends) if rows else {name: [] for name in tiles}
    tile = lambda name: sum(((F.struct(*orders[name]) > F.struct(*[F.lit(v).cast("long") for v in key])).cast("int")
                             for key in keys[name]), F.lit(1))
    return df.select("*", *[tile(name).cast("int").alias(name) for name in tiles])
