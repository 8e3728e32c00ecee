"""Exact time arithmetic and formatting.

Script seconds are rounded half to even; frame times are truncated, with fps as a decimal string
so that no floating point enters.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_to_centiseconds(seconds: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.rint(seconds * 100).cast("long"))


def frame_to_centiseconds(frame: Column, fps: str) -> Column:
    """floor(frame * 100 / fps), fps in its shortest decimal form."""
    sign, digits, exponent = Decimal(fps).as_tuple()
    if sign or not any(digits):
        raise ValueError("fps must be positive")
    whole = int("".join(map(str, digits)))
    scale = 10 ** max(0, -exponent)
    whole *= 10 ** max(0, exponent)
    product = frame.cast("decimal(20,0)") * F.lit(Decimal(100 * scale)).cast("decimal(18,0)")
    return F.greatest(F.lit(0).cast("long"), F.call_function("div", product, F.lit(Decimal(whole)).cast("decimal(38,0)")))


def format_centiseconds(cs: Column) -> Column:
    """H:MM:SS.cc"""
    return F.format_string(
        "%d:%02d:%02d.%02d",
        F.floor(cs / 360000),
        F.floor(cs % 360000 / 6000),
        F.floor(cs % 6000 / 100),
        cs % 100,
    )


def seconds_to_time(seconds: Column) -> Column:
    return format_centiseconds(seconds_to_centiseconds(seconds))


def frame_to_time(frame: Column, fps: str) -> Column:
    return format_centiseconds(frame_to_centiseconds(frame, fps))


def frame_to_seconds(frame: Column, fps: str) -> Column:
    return frame / F.lit(float(fps))
