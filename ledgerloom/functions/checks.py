"""Checks of single values as columns: each gives the names of what is wrong, or what a valid text means."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import text as T

MOST_CHARACTERS = 20_000
MOST_ITEMS = 10_000
# How dates and times are written.
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,6})?(?:Z|[+-][0-9]{2}:[0-9]{2})$"


def _no_fault() -> Column:
    return F.lit(None).cast("string")


def parsed_date(text: Column) -> Column:
    """The day of a text `YYYY-MM-DD`; null for anything else, and for days that no calendar has."""
    return F.when(text.rlike(DATE) & ~text.startswith("0000"), F.try_to_date(text, "yyyy-MM-dd"))


def parsed_time(text: Column) -> Column:
    """The instant of an ISO 8601 text with seconds and offset, at most 64 characters; null for anything else, for times that no clock shows, and beyond the years 1 to 9999.

    Offsets up to 23:59 count, more than Spark itself parses: the local time is taken as UTC and the offset subtracted."""
    offset = F.regexp_extract(text, r"([+-])([0-9]{2}):([0-9]{2})$", 0)
    hours, minutes = F.substring(offset, 2, 2).cast("int"), F.substring(offset, 5, 2).cast("int")
    local = F.try_to_timestamp(F.concat(F.regexp_replace(text, r"(?:Z|[+-][0-9]{2}:[0-9]{2})$", ""), F.lit("Z")))
    shift = F.when(offset == "", 0).otherwise((hours * 60 + minutes) * F.when(F.substring(offset, 1, 1) == "-", 1).otherwise(-1))
    instant = F.timestamp_micros(F.unix_micros(local) + shift.cast("bigint") * 60_000_000)
    good = text.rlike(TIME) & (F.length(text) <= 64) & ~text.startswith("0000") & ((offset == "") | ((hours < 24) & (minutes < 60)))
    micros = F.unix_micros(instant)
    return F.when(good & (micros >= -62_135_596_800_000_000) & (micros < 253_402_300_800_000_000), instant)


def string_faults(value: Column, empty_ok: bool = False, most: int = MOST_CHARACTERS) -> Column:
    """Names of a string's faults: `type` for null, `too_long` (nothing else is looked at then), `empty`, `control`, `direction`."""
    empty = _no_fault() if empty_ok else F.when(T.strip_white_space(value) == "", "empty")
    signs = F.when(value.rlike(T.CONTROL), "control").when(value.rlike(T.BIDI), "direction")
    return F.when(value.isNull(), F.array(F.lit("type"))).when(F.length(value) > most, F.array(F.lit("too_long"))).otherwise(F.array_compact(F.array(empty, signs)))


def list_faults(items: Column, empty_ok: bool = True, most: int = MOST_ITEMS) -> Column:
    """Names of the faults of a list of strings: `type` for null, `too_many`, `item_type` (null and blank items), `empty_list` (no item is left), `repeated`."""
    blank = lambda x: x.isNull() | (T.strip_white_space(x) == "")
    kept = F.filter(items, lambda x: ~blank(x))
    faults = F.array(
        F.when(F.size(items) > most, "too_many"), F.when(F.exists(items, blank), "item_type"),
        _no_fault() if empty_ok else F.when(F.size(kept) == 0, "empty_list"), F.when(F.size(kept) > F.size(F.array_distinct(kept)), "repeated"),
    )
    return F.when(items.isNull(), F.array(F.lit("type"))).otherwise(F.array_compact(faults))


def enum_faults(value: Column, allowed: tuple[str, ...]) -> Column:
    """string_faults(), and `enum` for a value that is none of the allowed ones."""
    own = string_faults(value)
    return F.when(F.size(own) > 0, own).otherwise(F.array_compact(F.array(F.when(~value.isin(*allowed), "enum"))))


def count_faults(value: Column) -> Column:
    """`type` for null and negative whole numbers."""
    return F.array_compact(F.array(F.when(value.isNull() | (value < 0), "type")))


def version_faults(value: Column, version: str) -> Column:
    """string_faults(), and `version` for another version."""
    own = string_faults(value)
    return F.when(F.size(own) > 0, own).otherwise(F.array_compact(F.array(F.when(value != version, "version"))))


def rounded(value: Column, digits: int) -> Column:
    """Rounded half up in decimals, as it is displayed; a double goes through its shortest decimal text."""
    return F.round(value.cast("string").cast("decimal(38,18)"), digits)
