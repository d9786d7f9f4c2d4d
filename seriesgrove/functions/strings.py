"""Scalar functions on text: templates, file names, UIDs, DICOM dates and times, sort keys."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidPatternError, MissingPlaceholderValueError

DISALLOWED = r"[^A-Za-z0-9 ._/\-]"
#: Header fields that hold a duration in milliseconds or seconds, and clock fields without "Time" rules of their own.
DURATIONS = ("EchoTime", "RepetitionTime", "InversionTime", "ExposureTime", "FrameTime", "FrameReferenceTime", "ActualFrameDuration")


def template_keys(pattern: str, letters_only: bool = False) -> list[str]:
    word = "[A-Za-z]+" if letters_only else r"\w+"
    return [a or b for a, b in re.findall(rf"%({word})|\{{({word})\}}", pattern)]


def template(pattern: str, values: dict[str, Column], letters_only: bool = False, missing: str | None = None) -> Column:
    """The pattern ({key} or %key) with its keys replaced by columns; planned once, on the driver."""
    word = "[A-Za-z]+" if letters_only else r"\w+"
    if not template_keys(pattern, letters_only):
        raise InvalidPatternError(f"no placeholder in {pattern!r}")
    parts, at = [], 0
    for m in re.finditer(rf"%({word})|\{{({word})\}}", pattern):
        key = m[1] or m[2]
        if key not in values and missing is None:
            raise MissingPlaceholderValueError(f"no value for {key!r} in {pattern!r}")
        parts += [F.lit(pattern[at : m.start()]), F.coalesce(values[key].cast("string"), F.lit(missing)) if missing is not None and key in values else values.get(key, F.lit(missing)).cast("string")]
        at = m.end()
    return F.concat(*parts, F.lit(pattern[at:]))


def sanitize_file_name(name: Column) -> Column:
    """Removes disallowed characters at both ends, then white space, joins words by _ and replaces the rest."""
    c = F.regexp_replace(name, rf"^({DISALLOWED})+|({DISALLOWED})+$", "")
    c = F.regexp_replace(c, r"^\s+|\s+$", "")
    c = F.replace(c, F.lit(" - "), F.lit("-"))
    c = F.regexp_replace(c, r"\s+", "_")
    return F.regexp_replace(c, rf"({DISALLOWED})+", "_")


def truncate_uid(uid: Column, n: int = 5) -> Column:
    return uid if n <= 0 else F.when(F.length(uid) <= n, uid).otherwise(F.right(uid, F.lit(n)))


def dicom_date(value: Column) -> Column:
    return F.when(value.rlike(r"\A[0-9]{8}\z"), F.try_to_date(value, "yyyyMMdd"))


def dicom_time_micros(value: Column) -> Column:
    """Microseconds since midnight of HHMMSS[.f], null if malformed."""
    part = lambda a, n: F.substring(value, a, n).cast("long")
    fraction = F.rpad(F.regexp_extract(value, r"\.([0-9]{1,6})", 1), 6, "0").cast("long")
    whole = (part(1, 2) * 3600 + part(3, 2) * 60 + part(5, 2)) * 1_000_000 + F.coalesce(fraction, F.lit(0))
    return F.when(value.rlike(r"\A([01][0-9]|2[0-3])[0-5][0-9][0-5][0-9](\.[0-9]{1,6})?\z"), whole)


def header_value(key: str, value: Column) -> Column:
    """A header field as ISO text, by the kind that its key tells; null if it is empty or malformed."""
    empty = value.isNull() | F.lower(value).isin("", "none")
    if key in DURATIONS:
        out = value.try_cast("double").cast("string")
    elif "Date" in key and "Time" not in key:
        out = F.date_format(dicom_date(value), "yyyy-MM-dd")
    else:
        s = F.expr("0")
        micros = dicom_time_micros(value)
        s = (micros / 1_000_000).cast("long")
        two = lambda c: F.lpad(c.cast("string"), 2, "0")
        out = F.concat_ws(":", two(F.floor(s / 3600)), two(F.floor(s / 60) % 60), two(s % 60))
        out = F.when(micros.isNotNull(), out)
    return F.when(~empty, out)


def convert_datetimes(header: Column) -> Column:
    """A header map with dates, times and durations in ISO form or as numbers, by key; what can't be read stays as it is."""
    time_ = lambda v: iso_time(dicom_time_micros(v))

    def one(k: Column, v: Column) -> Column:
        read = F.when(k.isin(*DURATIONS), v.try_cast("double").cast("string")).when(k.contains("Date"), F.date_format(dicom_date(v), "yyyy-MM-dd")).when(k.contains("Time"), time_(v))
        return F.coalesce(read, v)

    return F.transform_values(header, one)


def iso_time(micros: Column) -> Column:
    """HH:MM:SS of microseconds since midnight."""
    s = F.floor(micros / 1_000_000).cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when(micros.isNotNull(), F.concat_ws(":", two(F.floor(s / 3600)), two(F.floor(s / 60) % 60), two(s % 60)))


def natural_sort_key(value: Column) -> Column:
    """An array key: digit runs padded, the rest in lower case."""
    runs = F.regexp_extract_all(value, F.lit(r"\d+|\D+"), 0)
    return F.transform(runs, lambda t: F.when(t.rlike(r"^\d+$"), F.lpad(t, 20, "0")).otherwise(F.lower(t)))


def captured(value: Column, *patterns: tuple[str, int]) -> Column:
    """The first of several (pattern, group) captures that isn't empty; the last may be."""
    found = [F.regexp_extract(value, p, g) for p, g in patterns]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in found[:-1]], found[-1])


def full_match(value: Column, pattern: Column | str, ignore_case: bool = True) -> Column:
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.rlike(value, F.concat(F.lit("(?i)" if ignore_case else ""), F.lit(r"\A(?:"), p, F.lit(r")\z")))


def case_insensitive_glob(extension: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in extension)
