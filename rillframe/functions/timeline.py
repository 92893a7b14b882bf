"""Timestamp arithmetic and signal measures as column expressions. Times are whole microseconds unless a timebase is named; null means no timestamp."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def parse_ratio(text: str | int | float) -> Fraction:
    """A timebase or rate such as "30000/1001"."""
    return Fraction(str(text)).limit_denominator(1 << 24)


def by_stream(*keys: str, order: str = "seq") -> WindowSpec:
    """Arrival order of each stream."""
    return Window.partitionBy(*(keys or ("stream_id",))).orderBy(order)


def rescale(ts: Column, source: str | Fraction, target: str | Fraction) -> Column:
    """Ticks of one timebase in another, rounded to the nearest with ties away from zero; exact for 64-bit ticks."""
    factor = Fraction(source) / Fraction(target)
    num, den = F.lit(factor.numerator).cast("decimal(19,0)"), F.lit(factor.denominator).cast("decimal(19,0)")
    twice = F.abs(ts.cast("decimal(19,0)")) * num * 2 + den
    return (F.signum(ts).cast("long") * F.floor(twice / (den * 2)).cast("long")).cast("long")


def order_ts(dts: Column, pts: Column, media_packets: bool) -> Column:
    return dts if media_packets else pts


def discontinuity(ts: Column, window: WindowSpec, limit_us: int) -> Column:
    """True where time steps back, or ahead by more than the limit."""
    step = ts - F.lag(ts).over(window)
    return F.coalesce((step < 0) | (step > limit_us), F.lit(False))


def session_id(jump: Column, window: WindowSpec) -> Column:
    """Number of jumps so far."""
    return F.sum(jump.cast("long")).over(window.rowsBetween(Window.unboundedPreceding, 0))


def bcd(word: Column, shift: int, mask: int) -> Column:
    """A two-digit field of a timecode word; 0 if a digit isn't decimal."""
    field = F.shiftright(word, shift).bitwiseAND(mask)
    low, high = field.bitwiseAND(15), F.shiftright(field, 4)
    return F.when((low > 9) | (high > 9), 0).otherwise(high * 10 + low)


def smpte_ticks(word: Column, rate: Fraction, wide_frames: bool = False) -> Column:
    """Ticks (of 1/rate) of a 12M timecode word: whole seconds times the rate, divided without rest, plus frames."""
    frames = bcd(word, 24, 0x7F if wide_frames else 0x3F)
    if rate > 30 and not wide_frames:
        frames = frames * 2 + F.shiftright(word, 7 if rate == 50 else 23).bitwiseAND(1)
    seconds = bcd(word, 0, 0x3F) * 3600 + bcd(word, 8, 0x7F) * 60 + bcd(word, 16, 0x7F)
    return F.floor(seconds * rate.numerator / rate.denominator).cast("long") + frames


def gop_ticks(word: Column, rate: Fraction) -> Column:
    """Ticks of a group-of-pictures timecode."""
    part = lambda shift, mask: F.shiftright(word, shift).bitwiseAND(mask)
    seconds = part(19, 31) * 3600 + part(13, 63) * 60 + part(6, 63)
    return F.floor(seconds * rate.numerator / rate.denominator).cast("long") + part(0, 63)


def decibels(x: Column) -> Column:
    """20 log10 of an amplitude; null at 0."""
    return F.when(x > 0, 20 * F.log10(x))


def level_bin(x: Column) -> Column:
    """One of 17 level bins of 4 dB of a normalised sample."""
    a = F.abs(x)
    return F.when(a < 0.001, 0).when(a > 0.9885309, 16).otherwise(F.greatest(F.lit(0), F.least(F.lit(16), F.ceil(15 + 5 * F.log10(F.greatest(a, F.lit(1e-9)))).cast("int"))))
