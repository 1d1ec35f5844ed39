"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

UNICODE_SPACE = r"(?U)[\s\x1c-\x1f]+"
# what ``clean_lines`` changes: white space but blanks and line feeds, two of these in a row, one at either end
UNCLEAN = r"(?U)[\s\x1c-\x1f&&[^ \n]]|[ \n](?:[ \n]|\z)|\A[ \n]"


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives null, not an error, for a zero denominator."""
    return F.try_divide(numerator, denominator)


def finite(value: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def clean(value: Column, digits: int = 6) -> Column:
    """Finite value rounded half to even."""
    return F.bround(finite(value), digits)


def is_close(a: Column, b: Column, rtol: float, atol: float) -> Column:
    """Tolerance comparison; two nulls are equal, one null is not."""
    near = F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)
    return F.when(a.isNull() & b.isNull(), F.lit(True)).otherwise(F.coalesce(near, F.lit(False)))


def rows(window: WindowSpec, n: int) -> WindowSpec:
    return window.rowsBetween(-(n - 1), 0)


def full_frame(value: Column, aggregate: Column, window: WindowSpec, n: int) -> Column:
    """Rolling aggregate that stays null until the frame holds ``n`` values."""
    frame = rows(window, n)
    return F.when(F.count(value).over(frame) == n, aggregate.over(frame))


def rolling_mean(value: Column, window: WindowSpec, n: int) -> Column:
    return full_frame(value, F.avg(value), window, n)


def rolling_std(value: Column, window: WindowSpec, n: int) -> Column:
    return full_frame(value, F.stddev_samp(value), window, n)


def pct_change(value: Column, window: WindowSpec, n: int = 1) -> Column:
    return ratio(value, F.lag(value, n).over(window)) - 1


def with_ema(df: DataFrame, window: WindowSpec, position: str, wanted: dict[str, tuple[str, int]]) -> DataFrame:
    """Adds recursive exponential means, name -> (value column, span), as running sums.

    With the gap k to the last valid row, the weight of a valid value is a / (a + q^k) (1 for the first), so
    without nulls y = a*x + q*y'.  Writing P for the running product of the remaining weights,
    y_i = P_i * sum_j(w_j * x_j / P_j) over valid rows; a null row carries the last mean on.
    ``position`` is the row number inside the window partition; 1 / P stays in double range for the
    partition lengths the halo blocks produce (see operators.blocks).
    """
    so_far = window.rowsBetween(Window.unboundedPreceding, 0)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    out = df
    for value in dict.fromkeys(v for v, _ in wanted.values()):
        seen = F.last(F.when(F.col(value).isNotNull(), F.col(position)), ignorenulls=True).over(before)
        out = out.withColumn(f"_gap_{value}", F.col(position) - seen)
    weights, helpers = {}, {}
    for name, (value, span) in wanted.items():
        a = 2.0 / (span + 1)
        gap, valid = F.col(f"_gap_{value}"), F.col(value).isNotNull()
        left = F.pow(F.lit(1.0 - a), gap)
        weights[name] = F.when(gap.isNull(), F.lit(1.0)).when(gap == 1, F.lit(a)).otherwise(a / (a + left))
        # q^n for the n rows without a gap is exact to the last digit; only rows after a gap go through logarithms
        helpers[f"_even_{name}"] = F.count_if(valid & (gap == 1)).over(so_far)
        helpers[f"_log_{name}"] = F.coalesce(F.sum(F.when(valid & (gap > 1), F.ln(left / (a + left)))).over(so_far), F.lit(0.0))
    out = out.withColumns(helpers)
    means = {}
    for name, (value, span) in wanted.items():
        q, even, log = F.lit(1.0 - 2.0 / (span + 1)), F.col(f"_even_{name}"), F.col(f"_log_{name}")
        term = weights[name] * F.col(value) * F.pow(q, -even) * F.exp(-log)
        means[name] = F.pow(q, even) * F.exp(log) * F.sum(term).over(so_far)
    return out.withColumns(means).drop(*helpers, *[f"_gap_{v}" for v, _ in wanted.values()])


def split_words(value: Column) -> Column:
    return F.filter(F.split(value, UNICODE_SPACE), lambda x: x != "")


def one_spaced(value: Column) -> Column:
    """Every whitespace run as one blank, ends trimmed."""
    return F.trim(F.regexp_replace(value, UNICODE_SPACE, " "))


def clean_lines(value: Column) -> Column:
    """Line-wise whitespace collapse; blank lines are dropped.  A text with nothing to collapse is only searched, not taken apart."""

    def clean(text: Column) -> Column:
        lines = F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), one_spaced)
        return F.when(text.rlike(UNCLEAN), F.array_join(F.filter(lines, lambda x: x != ""), "\n")).otherwise(text)

    return F.get(F.transform(F.array(value), clean), F.lit(0))  # a lambda, so that ``value`` is made once


def first_text(*candidates: Column) -> Column:
    """The first candidate that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in candidates])


def sha(value: Column) -> Column:
    return F.sha2(value, 256)


def kept(*items: Column) -> Column:
    """Array of the non-null items, in order."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def _decimal(value: Column, pattern: str) -> Column:
    # the decimal formatter rounds the exact binary value half to even and is reused per task
    return F.call_function("format_number", value.cast("double"), F.lit(pattern))


def signed(value: Column, digits: int) -> Column:
    zeros = "0" + ("." + "0" * digits if digits else "")
    return _decimal(value, f"+{zeros};-{zeros}")


def fixed(value: Column, digits: int) -> Column:
    return _decimal(value, "0" + ("." + "0" * digits if digits else ""))


def percent(value: Column) -> Column:
    """Fraction as a whole percentage, such as 35%."""
    return F.concat(_decimal(value * 100, "0"), F.lit("%"))


def fill(template: str, *values: Column) -> Column:
    """A message with its %s places filled by text columns, as one concat."""
    pieces = [F.lit(p.replace("%%", "%")) for p in template.split("%s")]
    out = [pieces[0]]
    for value, piece in zip(values, pieces[1:], strict=True):
        out += [F.coalesce(value, F.lit("None")), piece]
    return F.concat(*out)
