"""Rules on table and column names."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def table_name(path: str, anywhere: bool = False) -> str:
    """Table name of a file: stem without the export marker, in title case.

    The marker is dropped at the start in any case; with ``anywhere`` every
    lower-case occurrence goes.
    """
    stem = os.path.splitext(os.path.basename(path.rstrip("/")))[0]
    if anywhere:
        stem = stem.replace("confidential_", "")
    else:
        stem = re.sub("^confidential_", "", stem, flags=re.IGNORECASE)
    return re.sub("[- ]", "_", stem).title()


@dataclass(frozen=True)
class KeyNames:
    """What a foreign-key column looks like and how its base name is found.

    ``suffix`` marks key columns and is removed from their base name; ``prefix``
    (none by default) is a table abbreviation to remove as well.
    """

    suffix: str = "_id"
    prefix: str | None = None

    @property
    def pattern(self) -> str:
        return f"({self.suffix})$"

    def matches(self, column: str) -> bool:
        return re.search(self.pattern, column) is not None

    def is_key_like(self, column: str) -> bool:
        return column == "id" or self.matches(column)

    def base(self, name: Column) -> Column:
        if self.prefix:
            name = F.regexp_replace(name, f"^{self.prefix}", "")
        return normalize_token(F.regexp_replace(name, self.pattern, ""))


def normalize_token(name: Column) -> Column:
    """Lower case, ``[a-z0-9_]`` only, singular form."""
    token = F.regexp_replace(F.lower(name), "[^a-z0-9_]", "")
    size = F.length(token)
    return (
        F.when(token.endswith("ies") & (size > 3), F.regexp_replace(token, "ies$", "y"))
        .when(
            token.endswith("s") & ~token.endswith("ss") & (size > 1),
            F.regexp_replace(token, "s$", ""),
        )
        .otherwise(token)
    )


def semantic_score(fk_base: Column, parent_base: Column, pk_base: Column) -> Column:
    """3 for the parent's name, 2 for its key's name, 1 for containment."""
    contained = fk_base.contains(parent_base) | parent_base.contains(fk_base)
    return (
        F.when(fk_base == parent_base, 3).otherwise(0)
        + F.when((pk_base != "") & (fk_base == pk_base), 2).otherwise(0)
        + F.when(contained, 1).otherwise(0)
    ).cast("int")
