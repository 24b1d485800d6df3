"""Deterministic numeric expressions, rendered for Spark SQL or DuckDB.

Floating-point sums depend on the order rows are added, which in a distributed
engine depends on partitioning. To keep every result reproducible (and equal to
an independent SQL engine), the operators follow three rules:

1. aggregate exactly: counts, integer sums and DECIMAL sums only;
2. non-integer per-row values that are averaged again (an order's mean review
   score) are carried as fixed-point integers (``to_fixed``);
3. scalar arithmetic happens once, after aggregation, as a fixed sequence of
   IEEE operations (``ratio``) followed by half-up rounding (``round_half_up``);
   ratios of integers are rounded exactly with integer arithmetic (``pct``).

Each helper renders SQL text; ``dialect="spark"`` is wrapped in ``F.expr`` by
the ``*_col`` variants, ``dialect="duckdb"`` is used by the oracle SQL.
Double literals are written in e-notation, which both engines parse as DOUBLE.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed-point unit for averaged non-integer values (micro-units).
FIXED_SCALE = 1_000_000


def _dec(x: str, dialect: str) -> str:
    return f"CAST({x} AS {'DECIMAL(38,0)' if dialect == 'spark' else 'HUGEINT'})"


def _idiv(a: str, b: str, dialect: str) -> str:
    """Integer division of non-negative operands; NULL for a zero divisor."""
    op = "div" if dialect == "spark" else "//"
    return f"(({a}) {op} NULLIF({b}, 0))"


def int_round(num: str, den: str, dialect: str = "spark") -> str:
    """round(num / den) to an integer, half away from zero, exact.

    ``num`` must be integral (integer or DECIMAL with zero fraction), ``den`` > 0.
    """
    n, d = _dec(num, dialect), _dec(den, dialect)
    pos = _idiv(f"{n} * 2 + {d}", f"{d} * 2", dialect)
    neg = _idiv(f"-{n} * 2 + {d}", f"{d} * 2", dialect)
    return f"CAST(CASE WHEN {n} < 0 THEN -{neg} ELSE {pos} END AS BIGINT)"


def avg_exact(total: str, den: str, digits: int = 2, dialect: str = "spark") -> str:
    """round(total / den, digits) as DOUBLE, exact: ``total * 10^digits`` must be integral."""
    s = 10 ** digits
    return f"(CAST({int_round(f'({total}) * {s}', den, dialect)} AS DOUBLE) / 1e{digits})"


def pct(num: str, den: str, digits: int = 2, dialect: str = "spark") -> str:
    """round(100 * num / den, digits) for integer counts, exact; NULL when den is 0."""
    return avg_exact(f"({num}) * 100", den, digits, dialect)


def ratio(num: str, den: str, dialect: str = "spark") -> str:
    """double(num) / double(den); NULL when den is 0."""
    return f"(CAST({num} AS DOUBLE) / NULLIF(CAST({den} AS DOUBLE), 0e0))"


def round_half_up(x: str, digits: int = 2, dialect: str = "spark") -> str:
    """Round a DOUBLE half away from zero to ``digits`` decimals."""
    s = f"1e{digits}"
    return (f"(SIGN(CAST({x} AS DOUBLE)) * FLOOR(ABS(CAST({x} AS DOUBLE)) * {s} + 5e-1)"
            f" / {s})")


def to_fixed(num: str, den: str, dialect: str = "spark") -> str:
    """round(num / den * FIXED_SCALE) as BIGINT (half away from zero)."""
    return int_round(f"({num}) * {FIXED_SCALE}", den, dialect)


# Column wrappers for the Spark side -------------------------------------------------

def pct_col(num: str, den: str, digits: int = 2) -> Column:
    return F.expr(pct(num, den, digits))


def round_col(x: str, digits: int = 2) -> Column:
    return F.expr(round_half_up(x, digits))


def to_fixed_col(num: str, den: str) -> Column:
    return F.expr(to_fixed(num, den))


def int_round_col(num: str, den: str) -> Column:
    return F.expr(int_round(num, den))


def avg_exact_col(total: str, den: str, digits: int = 2) -> Column:
    return F.expr(avg_exact(total, den, digits))
