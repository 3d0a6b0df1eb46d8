"""String expressions: aliases of names, parts of paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALIASES = {"united states": "usa", "united kingdom": "uk"}


def alias(name: Column, aliases: dict[str, str] = ALIASES) -> Column:
    """The name in lower case with single spaces, or its alias."""
    tidy = F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(known[tidy], tidy)


def first_path(url: Column) -> Column:
    """The first element of a path or URL's path; empty if there is none."""
    return F.split_part(F.regexp_replace(url, "^https?://", ""), F.lit("/"), F.lit(2))
