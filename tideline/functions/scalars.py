"""Scalar functions: parsing of loosely typed strings, day arithmetic, banding and display formats.

Every function takes and gives Columns, so it stays inside generated code and
costs no shuffle.
"""

from __future__ import annotations

import math
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

EVENING_HOUR = 18
NOON = 720
DAY_MINUTES = 1440
UNNAMED = "Sin nombre"


def is_num(c: Column) -> Column:
    """Present and finite."""
    c = c.cast("double")
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(math.inf)), F.lit(False))


def finite(c: Column) -> Column:
    """The value where finite, else null: NaN and infinities count as missing."""
    return F.when(is_num(c), c.cast("double"))


#: White space of a trimmed string: Unicode's, as Java's class leaves some out.
_BLANKS = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
_CLOCK = r"(?:[ ,T]+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*(AM|PM)?)?"
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_MONTH = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
_WEEKDAY = r"^(?:(?:sun|mon|tue|wed|thu|fri|sat)[a-z]*,? +)?"


def trimmed(raw: Column) -> Column:
    return F.regexp_replace(raw, f"^{_BLANKS}+|{_BLANKS}+$", "")


def of_parts(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """The time that parts name; parts beyond their range count on, so 30 February is a day of March.  Years below 100 are those of the twentieth century."""
    base = F.make_date(F.when(year < 100, year + 1900).otherwise(year), F.lit(1), F.lit(1))
    return F.date_add(F.add_months(base, month - 1), day - 1).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour, minute, second)


def parse_timestamp(raw: Column) -> Column:
    """Local wall-clock time of an ISO-like prefix, a US date with an optional AM/PM, a bare date, or a date with its month in words; else null.

    What follows the matched prefix (a zone, fractions) is ignored, and no time
    zone has a say in the times.
    """
    t = trimmed(raw)

    def parts(pattern: str, *groups: int) -> tuple[Column, list[Column]]:
        """Whether the text begins so, and its groups as numbers, 0 where one is empty."""
        return t.rlike(pattern), [F.coalesce(F.regexp_extract(t, pattern, g).try_cast("int"), F.lit(0)) for g in groups]

    def half_day(pattern: str, group: int, hour: Column) -> Column:
        half = F.upper(F.regexp_extract(t, pattern, group))
        return F.when((half == "PM") & (hour < 12), hour + 12).when((half == "AM") & (hour == 12), 0).otherwise(hour)

    def month_in_words(pattern: str, group: int) -> Column:
        return ((F.instr(F.lit(_MONTHS), F.lower(F.regexp_extract(t, pattern, group))) + 2) / 3).cast("int")

    # The forms of a time that are read.
    iso = r"^(\d{4})-(\d{2})-(\d{2})[ T](\d{1,2}):(\d{2})(?::(\d{2}))?"
    us = r"(?i)^(\d{1,2})/(\d{1,2})/(\d{4})[ ,]+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*(AM|PM)?"
    bare = r"^(\d{4})-(\d{2})-(\d{2})$"
    slashed = rf"(?i)^(\d{{4}})/(\d{{1,2}})/(\d{{1,2}}){_CLOCK}$"
    us_bare = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    month_first = rf"(?i){_WEEKDAY}{_MONTH} +(\d{{1,2}}),? +(\d{{4}}){_CLOCK}$"
    day_first = rf"(?i){_WEEKDAY}(\d{{1,2}}) +{_MONTH},? +(\d{{4}}){_CLOCK}$"
    is_iso, (y, m, d, h, mi, s) = parts(iso, 1, 2, 3, 4, 5, 6)
    out = F.when(is_iso, of_parts(y, m, d, h, mi, s))
    is_us, (m, d, y, h, mi, s) = parts(us, 1, 2, 3, 4, 5, 6)
    out = out.when(is_us, of_parts(y, m, d, half_day(us, 7, h), mi, s))
    is_bare, (y, m, d) = parts(bare, 1, 2, 3)
    zero = F.lit(0)
    out = out.when(is_bare, of_parts(y, m, d, zero, zero, zero))
    is_slashed, (y, m, d, h, mi, s) = parts(slashed, 1, 2, 3, 4, 5, 6)
    out = out.when(is_slashed & m.between(1, 12) & d.between(1, 31), of_parts(y, m, d, half_day(slashed, 7, h), mi, s))
    is_day, (m, d, y) = parts(us_bare, 1, 2, 3)
    out = out.when(is_day & m.between(1, 12) & d.between(1, 31), of_parts(y, m, d, zero, zero, zero))
    is_first, (d, y, h, mi, s) = parts(month_first, 2, 3, 4, 5, 6)
    out = out.when(is_first & d.between(1, 31), of_parts(y, month_in_words(month_first, 1), d, half_day(month_first, 7, h), mi, s))
    is_later, (d, y, h, mi, s) = parts(day_first, 1, 3, 4, 5, 6)
    return out.when(is_later & d.between(1, 31), of_parts(y, month_in_words(day_first, 2), d, half_day(day_first, 7, h), mi, s))


def parse_number(raw: Column) -> Column:
    """The number left of everything but digits, points and minus signs.

    Null for null, blank, ``-``, ``n/a`` and ``na``; letters alone leave nothing, which
    counts as zero.
    """
    t = trimmed(raw)
    left = F.regexp_replace(t, "[^0-9.-]", "")
    value = F.when(left == "", F.lit(0.0)).otherwise(finite(left.try_cast("double")))
    return F.when(t.isNull() | t.isin("", "-") | t.rlike("(?i)^n/?a$"), F.lit(None).cast("double")).otherwise(value)


def parse_boolean(raw: Column) -> Column:
    # The words that mean yes.
    return F.coalesce(F.lower(F.trim(raw)).isin("true", "yes", "1", "si", "sí"), F.lit(False))


def cycle_day(wake: Column, start: Column) -> Column:
    """The day of waking, else of the start, which from the evening on belongs to the next day."""
    return F.coalesce(F.to_date(wake), F.date_add(F.to_date(start), (F.hour(start) >= EVENING_HOUR).cast("int")))


def workout_day(start: Column, wake: Column, cycle_start: Column) -> Column:
    return F.coalesce(F.to_date(start), cycle_day(wake, cycle_start))


def activity_name(raw: Column) -> Column:
    return F.coalesce(F.when(F.trim(raw) != "", F.trim(raw)), F.lit(UNNAMED))


def iso_week(day: Column) -> Column:
    """The Monday of a day's week."""
    return F.to_date(F.date_trunc("week", day))


def weekday(day: Column) -> Column:
    """Sunday is 0."""
    return F.dayofweek(day) - 1


def month0(day: Column) -> Column:
    return F.month(day) - 1


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def bedtime_minute(ts: Column) -> Column:
    """Minute of the day, after midnight counted on from the day before."""
    m = minute_of_day(ts)
    return F.when(m < NOON, m + DAY_MINUTES).otherwise(m)


def clock_wrap(minutes: Column) -> Column:
    return F.pmod(minutes, F.lit(DAY_MINUTES))


def share(part: Column, whole: Column) -> Column:
    """A percentage, null where the whole is missing or zero."""
    return F.try_divide(part * 100, F.nullif(whole, F.lit(0)))


def shorten_question(q: Column, most: int = 34) -> Column:
    bare = F.regexp_replace(F.regexp_replace(q, r"^(?i:Have you|Did you|Do you|Have|Did)\s+", ""), r"\?$", "")
    return F.when(F.length(bare) > most, F.concat(F.rtrim(F.substring(bare, 1, most - 1)), F.lit("…"))).otherwise(bare)


@lru_cache(maxsize=1)
def _folded() -> tuple[str, str]:
    """The characters that decompose to a letter or digit of ASCII and marks, and what folding leaves of each."""
    pairs = {}
    for c in map(chr, range(0xA0, 0x20000)):
        plain = [x for x in unicodedata.normalize("NFD", c) if x.isascii() and x.isalnum()]
        if plain and not c.isascii():
            pairs[c] = plain[0]
    return "".join(pairs), "".join(pairs.values())


def normalize_text(c: Column) -> Column:
    """Accents folded, lower case, letters and digits only; marks that stand alone go with all else."""
    return F.regexp_replace(F.lower(F.translate(c, *_folded())), "[^a-z0-9]", "")


def recovery_band(v: Column) -> Column:
    return F.when(v.isNull(), "none").when(v < 34, "low").when(v < 67, "mid").otherwise("high")


def performance_band(v: Column) -> Column:
    return F.when(v >= 90, "high").when(v >= 70, "mid").when(v.isNotNull(), "low")


def load_verdict(acwr: Column) -> Column:
    return F.when(acwr > 1.35, "rising").when(acwr < 0.8, "falling").when(acwr.isNotNull(), "steady")


def z_band(z: Column) -> Column:
    return F.when(z < -1, "below").when(z > 1, "above").when(z.isNotNull(), "usual")


def category_slot(rank: Column, slots: int = 8) -> Column:
    """Places 0 to 7 keep a slot of their own, the rest share one."""
    return F.when(rank < slots, rank.cast("string")).otherwise("other")


def kpi_tone(delta: Column, direction: Column) -> Column:
    return F.when(delta.isNull() | (F.abs(delta) < 1e-9), "neutral").when(F.signum(delta) == direction, "up").otherwise("down")


def tick_step(low: Column, high: Column, count: int = 4) -> Column:
    """The least of 1, 2, 2.5, 5, 10 times a power of ten that needs at most ``count`` steps."""
    raw = (high - low) / count
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    steps = [1.0, 2.0, 2.5, 5.0, 10.0]
    return F.coalesce(*[F.when(power * s >= raw, power * s) for s in steps], power * steps[-1])


def nice_ticks(low: Column, high: Column, count: int = 4) -> tuple[Column, Column, Column]:
    """Step and outer ticks around a range; equal bounds are widened by one each way."""
    same = low == high
    lo, hi = F.when(same, low - 1).otherwise(low), F.when(same, high + 1).otherwise(high)
    step = tick_step(lo, hi, count)
    return step, F.floor(lo / step) * step, F.ceil(hi / step) * step


def angle(minute: Column) -> Column:
    return minute / DAY_MINUTES * (2 * math.pi) - math.pi / 2


def arc_span(start: Column, end: Column) -> Column:
    return F.when(end >= start, end - start).otherwise(end + DAY_MINUTES - start)


MISSING = "—"


def fmt_fixed(v: Column, decimals: int = 0) -> Column:
    return F.when(is_num(v), F.format_number(v, decimals)).otherwise(MISSING)


def fmt_unit(v: Column, decimals: int, unit: str) -> Column:
    return F.when(is_num(v), F.concat(F.format_number(v, decimals), F.lit(unit))).otherwise(MISSING)


def significant(v: Column, digits: int = 3) -> Column:
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(v))))
    return F.when(v == 0, F.lit(0.0)).when(is_num(v), F.round(v * scale) / scale)


def fmt_p(p: Column) -> Column:
    return F.when(~is_num(p), MISSING).when(p < 0.001, "< 0.001").otherwise(significant(p, 2).cast("string"))


def fmt_p_relation(p: Column) -> Column:
    """The p-value behind its sign, for use in a sentence."""
    return F.when(is_num(p) & (p < 0.001), fmt_p(p)).otherwise(F.concat(F.lit("= "), fmt_p(p)))


def fmt_duration(minutes: Column) -> Column:
    h = F.floor(minutes / 60)
    m = F.round(minutes - h * 60).cast("long")
    return F.when(is_num(minutes), F.concat(h.cast("string"), F.lit("h "), F.lpad(m.cast("string"), 2, "0"), F.lit("m"))).otherwise(MISSING)


def fmt_clock(minutes: Column) -> Column:
    t = clock_wrap(minutes)
    h = F.floor(t / 60)
    m = F.round(t - h * 60).cast("long")
    return F.when(is_num(minutes), F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(":"), F.lpad(m.cast("string"), 2, "0"))).otherwise(MISSING)


def fmt_signed(v: Column, decimals: int = 0, unit: str = "") -> Column:
    return F.when(is_num(v), F.concat(F.when(v > 0, "+").otherwise(""), F.format_number(v, decimals), F.lit(unit))).otherwise(MISSING)


def fmt_day(day: Column, pattern: str = "d MMM") -> Column:
    """A day in words; trailing points of abbreviations go."""
    return F.regexp_replace(F.date_format(day, pattern), r"\.", "")
