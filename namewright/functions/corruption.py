"""Corrupted names as Column expressions: what happens, and where, comes from md5 of seed, level, row and purpose."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_CHARACTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


def _draw(key: Column, purpose: str) -> Column:
    """A number from 0 to 1 for a row's key and a purpose."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{purpose}")).cast("binary")), 1, 8), 16, 10).cast("long") / 4294967296.0


def _below(key: Column, purpose: str, n: Column) -> Column:
    return F.floor(_draw(key, purpose) * n).cast("int")


def _part(text: Column, start: Column, length: Column) -> Column:
    return F.substring(text, start, F.greatest(length, F.lit(0)))


def typo(text: Column, key: Column) -> Column:
    """The first letter or digit from a drawn place on (from the start, if there is none) becomes a drawn one."""
    at = _below(key, "typo place", F.length(text))
    front, rest = _part(text, F.lit(1), at), _part(text, at + 1, F.length(text))
    other = _part(F.lit(_CHARACTERS), _below(key, "typo character", F.lit(len(_CHARACTERS))) + 1, F.lit(1))
    one = lambda t: F.regexp_replace(t, F.lit(r"^([^\p{L}\p{N}]*)[\p{L}\p{N}]"), F.concat(F.lit("$1"), other))
    return F.when(rest.rlike(r"[\p{L}\p{N}]"), F.concat(front, one(rest))).otherwise(one(text))


def swap(text: Column, key: Column) -> Column:
    """Two neighbouring characters change places."""
    at = _below(key, "swap place", F.length(text) - 1) + 1
    turned = F.concat(_part(text, F.lit(1), at - 1), _part(text, at + 1, F.lit(1)), _part(text, at, F.lit(1)), _part(text, at + 2, F.length(text)))
    return F.when(F.length(text) >= 2, turned).otherwise(text)


def drop_punctuation(text: Column, key: Column) -> Column:
    return F.regexp_replace(text, r"\p{Punct}", "")


def drop_token(text: Column, key: Column) -> Column:
    """One of several words is left out; the others are joined by one space."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    gone = _below(key, "dropped word", F.size(words))
    return F.when(F.size(words) > 1, F.array_join(F.filter(words, lambda w, i: i != gone), " ")).otherwise(text)


def spacing(text: Column, key: Column) -> Column:
    """Spaces vanish or double; a longer word without any is split."""
    spaced = F.replace(text, F.lit(" "), F.when(_draw(key, "spacing") < 0.5, F.lit("")).otherwise(F.lit("  ")))
    at = _below(key, "split place", F.length(text) - 2) + 1
    split = F.concat(_part(text, F.lit(1), at), F.lit(" "), _part(text, at + 1, F.length(text)))
    return F.when(F.contains(text, F.lit(" ")), spaced).when(F.length(text) > 4, split).otherwise(text)


#: Corruptions by name. The names are fixed values; further ones can be added.
CORRUPTIONS: dict[str, Callable[[Column, Column], Column]] = {
    "typo": typo,
    "swap": swap,
    "character_swap": swap,
    "drop_punctuation": drop_punctuation,
    "dropped_punctuation": drop_punctuation,
    "drop_token": drop_token,
    "dropped_token": drop_token,
    "spacing": spacing,
    "spacing_change": spacing,
}
DEFAULT = ("typo", "swap", "drop_punctuation", "drop_token", "spacing")


def _applied(operation: Callable[[Column, Column], Column], key: Column, use: Column) -> Callable[[Column], Column]:
    return lambda t: F.when(use, operation(t, key)).otherwise(t)


def corrupt(text: Column, row_id: Column, level: float, seed: int = 42, operations: tuple[str, ...] = DEFAULT) -> Column:
    """Each operation in turn with probability ``level``, one that is drawn if none would; level 0 changes nothing, null stays null.

    A row's draws depend on its id alone, so any partitioning gives the same texts.
    """
    if unknown := [o for o in operations if o not in CORRUPTIONS]:
        raise ValueError(f"unknown corruptions: {unknown}")
    if level <= 0 or not operations:
        return text
    key = F.concat(F.lit(f"{seed}:{level}:"), F.coalesce(row_id.cast("string"), F.lit("")))
    none = F.lit(True)
    for o in operations:
        none = none & (_draw(key, f"use {o}") > level)
    only = F.when(none, _below(key, "only", F.lit(len(operations)))).otherwise(-1)
    for i, o in enumerate(operations):
        use = (_draw(key, f"use {o}") <= level) | (only == i)
        # The text so far is bound once, else the expression would double with each operation.
        text = F.element_at(F.transform(F.array(text), _applied(CORRUPTIONS[o], key, use)), 1)
    return text
