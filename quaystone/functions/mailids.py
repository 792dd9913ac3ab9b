"""Canonical forms of message ids and of the paths under which messages are stored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"^[\s\xa0<]+|[\s\xa0>]+$"


def message_key(raw: Column) -> Column:
    """Id without angle brackets and outer whitespace, its host in lower case; null if nothing is left."""
    bare = F.regexp_replace(raw, _EDGE, "")
    at = F.length(bare) - F.length(F.substring_index(bare, "@", -1))
    folded = F.when(at > 0, F.concat(F.substring(bare, F.lit(1), at), F.lower(F.substring_index(bare, "@", -1)))).otherwise(bare)
    return F.when(F.length(bare) > 0, folded)


def message_keys(raw: Column) -> Column:
    """The ids in an array whose elements may each hold several, in order; never null."""
    ids = F.flatten(F.transform(F.coalesce(raw, F.array().cast("array<string>")), lambda x: F.split(F.coalesce(x, F.lit("")), r"[\s\xa0,;]+|(?<=>)(?=<)")))
    return F.filter(F.transform(ids, message_key), lambda x: x.isNotNull())


def path_key(raw: Column) -> Column:
    """A stored path with one kind of slash, none doubled, and no leading './'."""
    slashed = F.regexp_replace(F.translate(F.trim(raw), "\\", "/"), "/{2,}", "/")
    return F.regexp_replace(F.regexp_replace(slashed, r"/(\./)+", "/"), r"^(\./)+", "")


def is_blank(text: Column) -> Column:
    """Whether a text is null or holds white space only, that of Unicode included, such as no-break spaces."""
    return F.coalesce(~text.rlike(r"(?U)\S"), F.lit(True))
