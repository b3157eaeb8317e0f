"""Text, time and envelope functions."""

from __future__ import annotations

import base64
import json
import re
import zlib
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .udf import vectorised

ENVELOPE = "base64(zip(o))"


def parse_linestring(text: Column) -> Column:
    """`LINESTRING(lon lat, ...)` of unsigned numbers to array<struct<lat, lon>>."""
    pairs = F.regexp_extract_all(text, F.lit(r"([0-9.]+)\s+([0-9.]+)"), F.lit(0))
    return F.transform(pairs, lambda p: F.struct(F.split(p, r"\s+")[1].cast("double").alias("lat"), F.split(p, r"\s+")[0].cast("double").alias("lon")))


def unformat_pattern(template: str) -> tuple[str, list[str]]:
    """A regular expression for a `{name}` template, in which only dots are special outside the braces, and the names."""
    names = re.findall(r"\{(\w+)\}", template)
    return re.sub(r"\\?\{(\w+)\\?\}", "(.*)", template.replace(".", r"\.")), names


def unformat(template: str, text: Column) -> Column:
    """struct of the named parts of a text that was formatted by the template; nulls where it was not."""
    pattern, names = unformat_pattern(template)
    whole = f"^{pattern}$"
    return F.struct(*[F.when(text.rlike(whole), F.regexp_extract(text, whole, i + 1)).alias(n) for i, n in enumerate(names)])


def reformat(template: str, target: str, text: Column) -> Column:
    """The parts of a text under one template put into another."""
    parts = unformat(template, text)
    pieces = re.split(r"\{(\w+)\}", target)
    return F.concat(*[parts[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces)])


@vectorised("double")
def match_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two strings (matching blocks, not edit distance)."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@vectorised("double")
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The same over arrays."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, list(x), list(y)).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def strip_brackets(text: Column) -> Column:
    """What stands before the first bracket."""
    return F.trim(F.regexp_extract(text, r"^([^(（\[]*)", 1))


def arrival_time(text: Column, now: Column, roll: bool = True) -> Column:
    """`HH:MM` of today (tomorrow if over 12 hours ago and roll is set), a leading number of minutes from now, else null."""
    clock = F.regexp_extract(text, r"^\s*(\d{1,2}):(\d{2})\s*$", 1)
    minute = F.regexp_extract(text, r"^\s*(\d{1,2}):(\d{2})\s*$", 2)
    at = F.date_trunc("day", now) + F.make_dt_interval(hours=clock.try_cast("int"), mins=minute.try_cast("int"))
    if roll:
        at = F.when(at < now - F.expr("INTERVAL 12 HOURS"), at + F.expr("INTERVAL 1 DAY")).otherwise(at)
    minutes = F.regexp_extract(text, r"^\s*(\d+)", 1)
    return F.when(clock != "", at).when(minutes != "", now + F.make_dt_interval(mins=minutes.try_cast("int")))


def eta_clock(seconds: Column, now: Column) -> Column:
    """Seconds from now as clock text; `?` if negative."""
    return F.when(seconds < 0, F.lit("?")).otherwise(F.date_format(now + F.make_dt_interval(secs=seconds.cast("decimal(18,6)")), "HH:mm"))


def iso_time(text: Column) -> Column:
    """ISO-8601 with offset to an instant; null if it is none."""
    return F.try_to_timestamp(text)


def destination(direction: Column, departure: Column, destination_: Column, lang: str = "Zh_tw") -> Column:
    """Direction 1 goes to the destination, 2 back to the departure."""
    return F.trim(F.when(direction.cast("int") == 1, destination_.getField(lang)).when(direction.cast("int") == 2, departure.getField(lang)))


def cache_key(url: Column) -> Column:
    return F.sha2(url, 256)


def cache_key_base64(url: Column) -> Column:
    """URL-safe base64."""
    return F.translate(F.base64(url.cast("binary")), "+/", "-_")


def json_zip(value) -> dict:
    return {ENVELOPE: base64.b64encode(zlib.compress(json.dumps(value).encode("utf-8"))).decode("ascii")}


def json_unzip(value, insist: bool = True):
    """The value in an envelope. What is no envelope raises if insist is set, else it is returned as it is."""
    try:
        packed = value[ENVELOPE]
        if set(value) != {ENVELOPE}:
            raise KeyError(ENVELOPE)
    except (TypeError, KeyError, IndexError):
        if insist:
            raise RuntimeError("JSON is not in a zip envelope") from None
        return value
    try:
        raw = zlib.decompress(base64.b64decode(packed))
        return json.loads(raw)
    except (ValueError, zlib.error) as e:
        raise RuntimeError("the zip envelope cannot be read") from e


@vectorised("string")
def zip_json_text(texts: pd.Series) -> pd.Series:
    """JSON text to its envelope, as JSON text."""
    return pd.Series([None if t is None else json.dumps(json_zip(json.loads(t))) for t in texts], dtype=object)


@vectorised("string")
def unzip_json_text(texts: pd.Series) -> pd.Series:
    """JSON text, in an envelope or not, to plain JSON text; null if it is no JSON."""

    def one(t):
        try:
            return None if t is None else json.dumps(json_unzip(json.loads(t), insist=False))
        except (ValueError, RuntimeError):
            return None

    return pd.Series([one(t) for t in texts], dtype=object)


def pretty_json(value: Column) -> Column:
    return F.to_json(value, {"pretty": "true"})
