"""Scalar functions of the model, as built-in expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def parse_number(text: Column) -> Column:
    """A finite number written with digits, point, exponent and signs only; otherwise null."""
    x = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when(F.abs(x) < float("inf"), x)


def band(x: Column) -> Column:
    """The 1-2-5 band of a number, as a half-open interval in text; negatives are mirrored, zero is its own band.

    The decimal exponent comes from the number's decimal text, so decades are exact.
    """
    text = F.format_string("%.17e", F.abs(x))
    e = F.regexp_extract(text, r"e([+-]\d+)$", 1).cast("int")
    m = F.regexp_extract(text, r"^(.*)e", 1).cast("double")
    lo, hi, hi_e = F.when(m < 2, "1").when(m < 5, "2").otherwise("5"), F.when(m < 2, "2").when(m < 5, "5").otherwise("1"), F.when(m < 5, e).otherwise(e + 1)
    low, high = F.concat(lo, F.lit("e"), e.cast("string")), F.concat(hi, F.lit("e"), hi_e.cast("string"))
    return F.when(x == 0, "[0]").when(x > 0, F.concat(F.lit("["), low, F.lit(","), high, F.lit(")"))).when(x < 0, F.concat(F.lit("(-"), high, F.lit(",-"), low, F.lit("]")))


def token(kind: Column, text: Column) -> Column:
    """What is stored of a value: its text for categorical, boolean and discrete fields, its band for continuous ones."""
    return F.when(kind.isin("categorical", "boolean", "discrete"), text).when(kind == "continuous", band(parse_number(text)))


def is_eligible(kind: Column) -> Column:
    return kind.isin("categorical", "boolean", "discrete", "continuous")


OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def subnet24(text: Column) -> Column:
    """The /24 of a dotted quad without leading zeros."""
    quad = rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"
    return F.when(text.rlike(quad), F.concat(F.regexp_extract(text, r"^(\d+\.\d+\.\d+)\.", 1), F.lit(".0/24")))


def parent_domain(text: Column) -> Column:
    """A host name of three labels or more without its first; the last label has two letters or more."""
    host = F.lower(text)
    fits = host.rlike(r"^[a-z0-9_]([a-z0-9_-]*[a-z0-9_])?(\.[a-z0-9_]([a-z0-9_-]*[a-z0-9_])?)+\.[a-z]{2,}$")
    return F.when(fits, F.regexp_replace(host, r"^[^.]+\.", ""))


def major_version(text: Column) -> Column:
    """The first part of a version of two or three numbers; a pre-release or build tail is allowed."""
    return F.when(text.rlike(r"^v?\d+\.\d+(\.\d+)?([+-].*)?$"), F.regexp_extract(text, r"^v?(\d+)\.", 1))


def phase_of_day(at: Column) -> Column:
    """2 pi times the share of the day that has passed; negative times count backwards."""
    return F.lit(2 * math.pi) * F.pmod(at, F.lit(86_400_000_000)) / 86_400_000_000


def weekly_hour(at: Column) -> Column:
    """One of 168 cells, as three digits."""
    return F.lpad(F.pmod(F.floor(at / 3_600_000_000), F.lit(168)).cast("string"), 3, "0")


def derived(field: str, name: str) -> str:
    """The name of what ``name`` derives from a field."""
    return f"{field}×{name}"


def parent_of(field: Column) -> Column:
    """The field that a derived one comes from; any other field itself."""
    return F.split_part(field, F.lit("×"), F.lit(1))


def derivation_of(field: Column) -> Column:
    """What was derived from the parent; null for a field that is not derived."""
    return F.when(F.contains(field, F.lit("×")), F.split_part(field, F.lit("×"), F.lit(2)))


def pair_field(a: Column, b: Column) -> Column:
    return F.concat(F.least(a, b), F.lit("×"), F.greatest(a, b))


def pair_value(fa: Column, va: Column, fb: Column, vb: Column) -> Column:
    """Both values in the order of their fields, then of the values."""
    first = F.struct(fa.alias("f"), va.alias("v")) <= F.struct(fb.alias("f"), vb.alias("v"))
    return F.when(first, F.concat(va, F.lit("\x1f"), vb)).otherwise(F.concat(vb, F.lit("\x1f"), va))


def null_scale(n: Column) -> Column:
    """sqrt(2 ln ln n) from 3 on, 0 below."""
    return F.when(n >= 3, F.sqrt(2 * F.log(F.log(n.cast("double"))))).otherwise(F.lit(0.0))


def sidak(p: Column, tests: Column) -> Column:
    """1 - (1 - p) ** tests, stable for small p."""
    return F.when(p >= 1, F.lit(1.0)).otherwise(-F.expm1(tests * F.log1p(-p)))


def sidak_log(log_p: Column, tests: Column) -> Column:
    """The logarithm of ``sidak``; for the smallest p, where 1 - p rounds to 1, tests * p is exact."""
    return F.when(log_p < -30, F.log(tests.cast("double")) + log_p).when(log_p >= 0, F.lit(0.0)).otherwise(F.log(-F.expm1(tests * F.log1p(-F.exp(log_p)))))


def fisher_tail(x2: Column, j: Column) -> Column:
    """Survival of chi-square with 2 j degrees of freedom: exp(-x/2) times a finite sum."""
    half = x2 / 2
    s = F.aggregate(F.sequence(F.lit(1), F.greatest(j - 1, F.lit(1)).cast("int")), F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), lambda acc, i: F.when(i < j, F.struct((acc["term"] * half / i).alias("term"), (acc["sum"] + acc["term"] * half / i).alias("sum"))).otherwise(acc), lambda acc: acc["sum"])
    return F.when(j > 0, F.least(F.lit(1.0), F.exp(-half) * s))


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Lower and upper bound of a proportion; 0 and 1 without trials."""
    p, zz = hits / n, z * z
    mid, half = (p + zz / (2 * n)) / (1 + zz / n), z / (1 + zz / n) * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    return F.when(n > 0, F.greatest(F.lit(0.0), mid - half)).otherwise(F.lit(0.0)), F.when(n > 0, F.least(F.lit(1.0), mid + half)).otherwise(F.lit(1.0))
