"""Scalar functions as columns: times, quarters, text, money and identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

#: The seconds of each timeframe.
TIMEFRAMES = {"15m": 900, "1h": 3600, "1d": 86_400, "1w": 604_800}
#: Fixed value: filings from this day on give values in dollars, earlier ones in thousands.
CUTOVER = "2023-01-03"


def floor_div(a, b):
    """Quotient rounded down, also of negative numbers."""
    return F.floor(a / b).cast("long")


def civil(t):
    """(y, m, d, weekday from 0 on Sunday) of seconds since the epoch, in UTC."""
    day = F.date_from_unix_date(floor_div(t, F.lit(86_400)).cast("int"))
    return F.struct(F.year(day).alias("y"), F.month(day).alias("m"), F.dayofmonth(day).alias("d"), (F.dayofweek(day) - 1).alias("weekday"))


def utc_seconds(y, m, d):
    return F.unix_date(F.make_date(y, m, d)).cast("long") * 86_400


def format_rfc3339(t):
    """Seconds since the epoch as YYYY-MM-DDTHH:MM:SSZ."""
    return F.date_format(F.timestamp_seconds(t), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_rfc3339(s):
    """Seconds since the epoch of YYYY-MM-DDTHH:MM:SSZ; null for any other text."""
    fine = s.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$")
    return F.when(fine, F.unix_timestamp(F.try_to_timestamp(F.substring(s, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))))


def parse_day_start(s):
    """Seconds at the start of YYYY-MM-DD; null for any other text."""
    fine = s.rlike(r"^\d{4}-\d{2}-\d{2}$")
    return F.when(fine, F.unix_timestamp(F.try_to_timestamp(s, F.lit("yyyy-MM-dd"))))


def timeframe_seconds(tf):
    out = F.lit(None).cast("long")
    for name, n in TIMEFRAMES.items():
        out = F.when(tf == name, F.lit(n).cast("long")).otherwise(out)
    return out


def is_quarter(q):
    return q.rlike("^[0-9]{4}Q[1-4]$")


def quarter_of(day):
    return F.concat(F.date_format(day, "yyyy"), F.lit("Q"), F.quarter(day))


def quarter_start(q):
    """First day of YYYYQn; null where it is none."""
    return F.when(is_quarter(q), F.make_date(F.substring(q, 1, 4).cast("int"), F.substring(q, 6, 1).cast("int") * 3 - 2, F.lit(1)))


def quarter_bounds(q):
    """(start, end) of a quarter in seconds, the end being the next one's start."""
    start = quarter_start(q)
    return F.struct((F.unix_date(start).cast("long") * 86_400).alias("start"), (F.unix_date(F.add_months(start, 3)).cast("long") * 86_400).alias("end"))


def shift_quarter(q, n: int):
    """The quarter ``n`` later, or earlier."""
    return quarter_of(F.add_months(quarter_start(q), 3 * n))


def placebo_quarter(q, available):
    """The first of a year before, the next and the previous quarter that ``available`` (an array) holds; '' if none."""
    out = F.lit("")
    for n in (-1, 1, -4):
        c = shift_quarter(q, n)
        out = F.when(F.array_contains(available, c), c).otherwise(out)
    return out


def looks_like_fund(name):
    """Whether a name reads like a fund: its words, not parts of words, with a plural s."""
    n = F.lower(name)

    def word(w):
        return n.rlike(rf"(^|[^a-z]){w}(s?([^a-z]|$))")

    brand = n.contains("ishares") | n.contains("spdr") | n.contains("proshares") | n.contains("invesco qqq")
    return word("etf") | word("etn") | brand | word("fund") | word("trust") & (word("index") | word("shares"))


def normalise_ticker(t):
    return F.replace(F.upper(F.trim(F.coalesce(t, F.lit("")))), F.lit("/"), F.lit("."))


def clean_cusip(c):
    return F.upper(F.trim(F.coalesce(c, F.lit(""))))


def url_encode(s):
    """Percent-encoding of all but letters, digits and - . _ ~."""
    return F.replace(F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def csv_field(s):
    """A field in quotes, with its quotes doubled, where it holds a comma, a quote or a line's end."""
    return F.when(s.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def sql_str(s):
    """A text as an SQL literal."""
    return F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("''")), F.lit("'"))


def value_to_usd(value, filed):
    """Filed value in dollars."""
    return F.when(F.to_date(filed) >= F.lit(CUTOVER).cast("date"), value).otherwise(value * 1000)


def number(s):
    """A filed number: blank is 0, commas are dropped, null where it is none."""
    t = F.replace(F.trim(F.coalesce(s, F.lit(""))), F.lit(","), F.lit(""))
    return F.when(t == "", F.lit(0.0)).otherwise(t.try_cast("double"))


def decades(deviation):
    """The multiple of three powers of ten that a log deviation sits at, within a factor of 3; else 0."""
    k = 3 * F.round(deviation / (3 * F.ln(F.lit(10.0)))).cast("int")
    return F.when((k != 0) & (F.abs(deviation - k * F.ln(F.lit(10.0))) < F.ln(F.lit(3.0))), k).otherwise(0)


def rescale(value, k):
    """A value with its units error of 10^k taken out."""
    return value * F.pow(F.lit(10.0), -k)


def display_height(h, mode: str = "signed-log"):
    """Height of a hotness as shown: signed logarithm, or itself."""
    return h if mode == "linear" else F.signum(h) * F.log1p(F.abs(h))


def landscape_value(h, pi, n_active, size_share, value: str = "pi_rel_size", mode: str = "signed-log"):
    """The logarithm of pi N or of pi over the size share, or the shown hotness; null where there is none."""
    if value == "hotness":
        return display_height(h, mode)
    x = pi * n_active if value == "pi" else F.when(size_share > 0, pi / size_share)
    return F.when(x > 0, F.ln(x))


def fnv1a(text: str) -> str:
    """64-bit FNV-1a digest of a text as 16 hex digits (fixed values: its offset and prime)."""
    h = 1469598103934665603
    for byte in text.encode():
        h = (h ^ byte) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"
