"""SMPTE timecodes in integer frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIMECODE = r"(\d{2}):(\d{2}):(\d{2})([:;])(\d{2})"
# Frames in ten drop-frame minutes and in one that drops two.
TEN_MINUTES, MINUTE = 17982, 1798
#: Frames after which drop-frame codes begin again.
DAY = 30 * 60 * 60 * 24


def is_valid(tc: Column) -> Column:
    return F.trim(tc).rlike(f"^{TIMECODE}$")


def frame_rate(rate: Column) -> Column:
    """'24000/1001' as 23.976."""
    top, low = F.split_part(F.trim(rate), F.lit("/"), F.lit(1)).cast("double"), F.split_part(F.trim(rate), F.lit("/"), F.lit(2))
    bottom = F.when(low == "", 1.0).when(low.cast("double") == 0, 1.0).otherwise(low.try_cast("double"))
    return F.when(rate.contains("/"), F.round(top / bottom, 3)).otherwise(F.trim(rate).try_cast("double"))


def nominal_rate(fps: Column) -> Column:
    """24, 25 or 30, whichever is nearest to the rounded rate; the lower one of two as near."""
    r = F.bround(fps)
    return F.when(r.isin(24, 25, 30), r).when(r < 24, 24).when(r <= 27, 25).otherwise(30).cast("int")


def _two(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def _clock(seconds: Column, frames: Column, sep: str) -> Column:
    h, m, s = (F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60)
    return F.concat(_two(h), F.lit(":"), _two(m), F.lit(":"), _two(s), F.lit(sep), _two(frames))


def frame_to_tc(frame: Column, rate: Column) -> Column:
    return _clock(F.floor(frame / rate), frame % rate, ":")


def frame_to_tc_drop(frame: Column) -> Column:
    """The code within its day: frames of DAY and more begin again, those below 0 count back from its end."""
    f = F.pmod(frame, F.lit(DAY))
    tens, rest = F.floor(f / TEN_MINUTES), f % TEN_MINUTES
    g = f + 18 * tens + F.when(rest > 2, 2 * F.floor((rest - 2) / MINUTE)).otherwise(0)
    return _clock(F.floor(g / 30), g % 30, ";")


def tc_to_frames(tc: Column, rate: Column) -> Column:
    """Frames of a four-part code; null for any other string."""
    p = lambda i: F.regexp_extract(F.trim(tc), f"^{TIMECODE}$", i).try_cast("long")
    minutes = p(1) * 60 + p(2)
    drop = 108000 * p(1) + 1800 * p(2) + 30 * p(3) + p(5) - 2 * (minutes - F.floor(minutes / 10))
    return F.when(tc.contains(";"), drop).otherwise((minutes * 60 + p(3)) * rate + p(5))


def duration(tc_in: Column, tc_out: Column, rate: Column) -> Column:
    return frame_to_tc(tc_to_frames(tc_out, rate) - tc_to_frames(tc_in, rate), rate)


def seconds_to_frame(seconds: Column, fps: Column) -> Column:
    return F.bround(seconds * fps).cast("long")


def file_timestamp(part: Column, length: Column, offset: Column) -> Column:
    """'[HH:MM:SS]' of an offset in the part-th piece of a file."""
    t = F.floor(part * length + offset).cast("long")
    return F.concat(F.lit("["), _two(F.floor(t / 3600)), F.lit(":"), _two(F.floor(t / 60) % 60), F.lit(":"), _two(t % 60), F.lit("]"))
