"""Glob patterns and the exclusion rules made of them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions.paths import lower


def check_globs(patterns: list[str]) -> None:
    for p in patterns:
        if "[" in p:
            raise ValueError(f"invalid glob pattern (character classes aren't supported): {p}")


def glob_regex(pattern: str) -> str:
    """``*`` is any run of characters, ``/`` included, ``?`` any one character, all else itself; case counts."""
    out = "".join(".*" if c == "*" else "." if c == "?" else "\\Q" + c + "\\E" if not c.isalnum() else c for c in re.sub(r"\*+", "*", pattern))
    return rf"(?s)\A{out}\z"


def matches_any(text: Column, patterns: list[str]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | text.rlike(glob_regex(p))
    return hit


@dataclass(frozen=True)
class Excludes:
    """Path globs and tag names (with ``#``, lower case) that queries leave out."""

    paths: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)

    @classmethod
    def merged(cls, config_paths: list[str], config_tags: list[str], paths: list[str] = (), tags: list[str] = ()) -> Excludes:
        both = [*config_paths, *paths]
        check_globs(both)
        marked = [t if t.startswith("#") else f"#{t}" for t in [*config_tags, *tags]]
        return cls(both, [t.lower() for t in marked])

    def keeps_path(self, path: Column) -> Column:
        """Rows without a path stay."""
        return F.lit(True) if not self.paths else path.isNull() | ~matches_any(path, self.paths)

    def keeps_tag(self, name: Column) -> Column:
        return F.lit(True) if not self.tags else ~lower(name).isin(self.tags)

    def keeps_via(self, kind: Column, name: Column, path: Column) -> Column:
        """Tags go by name, notes and assets by path; a phantom is never left out."""
        return F.when(kind == "tag", self.keeps_tag(name)).when(kind.isin("note", "asset"), self.keeps_path(path)).otherwise(F.lit(True))
