"""Scalar column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp (the session zone is UTC)."""
    return F.unix_micros(col(ts).cast("timestamp"))


def seconds(ts: Column | str) -> Column:
    return micros(ts) / F.lit(1e6)


def from_micros(us: Column | str) -> Column:
    return F.timestamp_micros(col(us)).cast("timestamp_ntz")


def from_epoch_seconds(s: Column | str) -> Column:
    """Epoch seconds (whole or fractional) with their unit stated, never read as nanoseconds."""
    return F.timestamp_micros((col(s).cast("double") * 1000000).cast("bigint")).cast("timestamp_ntz")


def finite(c: Column | str) -> Column:
    """NaN and both infinities become null, everything else is kept."""
    x = col(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def to_number(c: Column | str, default: float | None = None) -> Column:
    """Text to double; text that is no number becomes null or the default."""
    parsed = finite(F.expr("null").cast("double")) if c is None else finite(col(c).try_cast("double"))
    return parsed if default is None else F.coalesce(parsed, F.lit(float(default)))


def clip(c: Column | str, low, high) -> Column:
    """Clamp to [low, high]; null stays null."""
    x = col(c)
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.when(x < low, low).when(x > high, high).otherwise(x)


def ratio(a: Column | str, b: Column | str, default: float = 0.0) -> Column:
    """a / b, with the default where b is zero or null."""
    return F.coalesce(F.try_divide(col(a).cast("double"), col(b).cast("double")), F.lit(float(default)))


def ipv4_to_long(ip: Column | str) -> Column:
    """Dotted IPv4 text to its 32-bit value as bigint; null where it is no IPv4 text
    or an octet is above 255."""
    text = col(ip)
    parts = F.split(text, r"\.")
    octets = [parts[i].cast("bigint") for i in range(4)]
    value = octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3]
    valid = text.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    return F.when(valid & (F.greatest(*octets) <= 255), value)


def severity_band(confidence: Column | str, scheme: str = "alert") -> Column:
    """Severity words for a confidence.

    ``alert``: above 0.85 HIGH, else MEDIUM. ``percent``: above 85 high, above 70
    medium, else low. ``flag``: above 70 critical, else normal.
    """
    x = col(confidence)
    if scheme == "alert":
        return F.when(x > 0.85, "HIGH").when(x.isNotNull(), "MEDIUM")
    if scheme == "percent":
        return F.when(x > 85, "high").when(x > 70, "medium").when(x.isNotNull(), "low")
    if scheme == "flag":
        return F.when(x > 70, "critical").when(x.isNotNull(), "normal")
    raise ValueError(f"unknown scheme {scheme!r}")


def folder_label(path: Column | str, skip: int = 4, depth: int = 2, sep: str = "_") -> Column:
    """Class label from a folder name: its ``sep``-separated words after the first ``skip``.

    ``depth`` counts path segments from the end (2 = the folder that holds the file).
    """
    words = F.split(F.element_at(F.split(col(path), "/"), -depth), f"\\Q{sep}\\E")
    return F.array_join(F.slice(words, skip + 1, F.greatest(F.size(words) - skip, F.lit(0))), sep)


def parse_log_line(line: Column | str) -> dict[str, Column]:
    """Fields of ``[timestamp] message from address``; null where a line does not match."""
    pattern = r"^\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d+)?)\] (.*) from (\S+)$"
    text = col(line)
    part = lambda i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    return {"ts": part(1).try_cast("timestamp_ntz"), "message": part(2), "ip": part(3)}


def inverse_normal(p: Column | str) -> Column:
    """Quantile of the standard normal by Acklam's rational approximation (relative error 1.2e-9)."""
    # Fixed values of the published approximation.
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
         1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
         6.680131188771972e01, -1.328068155288572e01)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
         -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)

    def horner(coefficients, x):
        total = F.lit(coefficients[0])
        for k in coefficients[1:]:
            total = total * x + F.lit(k)
        return total

    p = col(p)
    cut = 0.02425
    low_q = F.sqrt(F.lit(-2.0) * F.log(p))
    high_q = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - p))
    mid_q = p - 0.5
    r = mid_q * mid_q
    tail = lambda q: horner(c, q) / (horner(d, q) * q + 1.0)
    middle = horner(a, r) * mid_q / (horner(b, r) * r + 1.0)
    return F.when(p < cut, tail(low_q)).when(p > 1 - cut, -tail(high_q)).otherwise(middle)
