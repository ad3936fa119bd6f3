"""The eight raw-value parsers as Column builders (F01-F10): each gives (value, error).

`error` is null where the value was read or is a sentinel for "unknown"; a parser never fails a whole batch.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import ConfigError

# What sources write for "no value", and the suffixes of magnitudes.
SENTINELS = ("-", "n/a", "—")
MAGNITUDES = (("k", 1_000), ("m", 1_000_000), ("b", 1_000_000_000))
TRUE_WORDS, FALSE_WORDS = ("true", "yes", "y", "1"), ("false", "no", "n", "0")

NUMBER = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+)([eE][+-]?\d+)?$"
WIDE = "decimal(38,18)"


class Parsed(NamedTuple):
    value: Column
    error: Column


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def unknown(c: Column) -> Column:
    """Null, blank or a sentinel."""
    return c.isNull() | (_strip(c) == "") | F.lower(_strip(c)).isin(*SENTINELS)


def _result(c: Column, value: Column, name: str) -> Parsed:
    value = F.when(~unknown(c), value)
    return Parsed(value, F.when(~unknown(c) & value.isNull(), F.concat(F.lit(f"{name}: cannot read "), c)))


def human_number(c: Column, name: str = "human_number") -> Parsed:
    """1,234 / 1.2K / 3.4M / 2B."""
    text = F.regexp_replace(_strip(c), ",", "")
    last = F.lower(F.right(text, F.lit(1)))
    factor = F.lit(1).cast("decimal(10,0)")
    for suffix, n in MAGNITUDES:
        factor = F.when(last == suffix, F.lit(n).cast("decimal(10,0)")).otherwise(factor)
    body = F.when(last.isin(*[s for s, _ in MAGNITUDES]), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    exact = F.when(_strip(body).rlike(NUMBER), F.regexp_replace(_strip(body), "_", "").try_cast("decimal(28,10)"))
    return _result(c, F.try_multiply(exact, factor).cast(WIDE), name)


def percent_or_number(c: Column) -> Parsed:
    """As human_number, after one trailing percent sign; percent points stay percent points."""
    out = human_number(F.regexp_replace(_strip(c), "%$", ""), "percent_or_number")
    return Parsed(F.when(~unknown(c), out.value), F.when(~unknown(c), out.error))


def iso8601_with_offset(c: Column) -> Parsed:
    """Milliseconds, floored; an instant without an offset is refused, not guessed."""
    text = _strip(c)
    ok = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$")
    value = F.when(ok, F.unix_millis(F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp")))
    return Parsed(value, F.when(value.isNull(), F.concat(F.lit("iso8601_with_offset: needs an offset: "), F.coalesce(c, F.lit("null")))))


def _epoch(c: Column, scale: int, name: str) -> Parsed:
    ms = F.when(_strip(c).rlike(NUMBER), F.try_multiply(_strip(c).try_cast("decimal(28,9)"), F.lit(scale).cast("decimal(4,0)")))
    return _result(c, F.when(ms == F.floor(ms), ms.cast("long")), name)


def epoch_seconds(c: Column) -> Parsed:
    """Whole milliseconds only; finer is refused."""
    return _epoch(c, 1000, "epoch_seconds")


def epoch_millis(c: Column) -> Parsed:
    return _epoch(c, 1, "epoch_millis")


def date_in_zone(c: Column, zone: str, hour: int = 0) -> Parsed:
    """The day part of the text at `hour` o'clock in `zone`, as UTC milliseconds; gaps and folds as the zone rules say."""
    day = F.when(_strip(c).rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), F.substring(_strip(c), 1, 10).try_cast("date"))
    local = F.to_timestamp(day) + F.expr(f"interval {int(hour)} hours")
    return Parsed(F.unix_millis(F.to_utc_timestamp(local, zone)), F.when(day.isNull(), F.concat(F.lit("date_in_zone: cannot read "), F.coalesce(c, F.lit("null")))))


def enum_ordinal(c: Column, mapping: dict[str, int]) -> Parsed:
    """The number of a label, whatever its case; an unknown label is null, no error."""
    pairs = [F.lit(x) for k, v in mapping.items() for x in (k.lower(), int(v))]
    value = F.when(~unknown(c), F.try_element_at(F.create_map(*pairs), F.lower(_strip(c)))) if pairs else F.lit(None).cast("int")
    return Parsed(value, F.lit(None).cast("string"))


def boolean(c: Column) -> Parsed:
    word = F.lower(_strip(c))
    return _result(c, F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False), "boolean")


def quiet_number(c: Column) -> Column:
    """Blank or unreadable is null without an error."""
    return human_number(c).value


PARSERS: dict[str, Callable[..., Parsed]] = {f.__name__: f for f in (human_number, percent_or_number, iso8601_with_offset, epoch_seconds, epoch_millis, date_in_zone, enum_ordinal, boolean)}


def apply(name: str, c: Column, **options) -> Parsed:
    if name not in PARSERS:
        raise ConfigError(f"unknown parser {name!r}; known: {', '.join(PARSERS)}")
    return PARSERS[name](c, **options)


def null_if(c: Column, exact: list[str] = (), prefixes: list[str] = ()) -> Column:
    """Null where the value equals one of `exact`, trimmed or not, or opens with one of `prefixes`."""
    out = c
    if exact:
        out = F.when(c.isin(*exact) | _strip(c).isin(*exact), None).otherwise(out)
    for p in prefixes:
        out = F.when(_strip(c).startswith(p), None).otherwise(out)
    return out
