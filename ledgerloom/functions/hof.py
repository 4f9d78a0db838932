"""Small helpers over arrays and maps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it several times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


# every kind of blank, spelled out (much faster than the Unicode flag)
BLANKS = r"\s\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLANK_CHARS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Trim every kind of blank, the no-break space included."""
    return F.regexp_replace(text, f"^[{BLANKS}]+|[{BLANKS}]+$", "")


def any_pattern(patterns: list[str]) -> str:
    """One case-insensitive alternation."""
    return "(?iU)" + "|".join(f"(?:{p})" for p in patterns)


def last_entries(entries: Column) -> Column:
    """Entries (structs with field ``key``) without those a later one replaces."""
    return let(
        entries,
        lambda all_: F.filter(
            all_,
            lambda e, i: ~F.exists(
                F.slice(all_, i + F.lit(2), F.size(all_)), lambda later: later["key"] == e["key"]
            ),
        ),
    )


def map_last_wins(entries: Column) -> Column:
    return F.map_from_entries(last_entries(entries))


def merge_maps(base: Column, update: Column) -> Column:
    """Both maps; the update wins on shared keys."""
    base = F.coalesce(base, F.create_map().cast("map<string,string>"))
    update = F.coalesce(update, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(update, k)), update)


def presence(value: Column) -> Column:
    """Null for a null or empty string."""
    return F.nullif(value, F.lit(""))
