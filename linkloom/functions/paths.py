"""Vault paths as Column expressions: cleaning, parts, keys and the tests on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space, for character classes of Java patterns.
WS = r"\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def lower(text: Column) -> Column:
    """Lower case letter by letter, so that a key doesn't depend on a letter's place in the word."""
    return F.lower(F.translate(text, "İΣ", "iσ"))


def trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A[{WS}]+|[{WS}]+\z", "")


def _fold(parts: Column, rooted: Column) -> Column:
    """The segments with ``..`` worked off; above the root they vanish, above a relative path they stay."""

    def step(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        up = F.when(last.isNotNull() & (last != ".."), F.slice(done, 1, F.size(done) - 1)).when(rooted, done).otherwise(F.concat(done, F.array(part)))
        return F.when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    return F.aggregate(parts, F.array().cast("array<string>"), step)


def clean(path: Column) -> Column:
    """The shortest equal path: no empty, ``.`` or needless ``..`` segments; ``.`` if nothing is left."""
    rooted = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    out = F.concat(F.when(rooted, F.lit("/")).otherwise(F.lit("")), F.array_join(_fold(parts, rooted), "/"))
    # most paths are clean already, and the fold isn't compiled
    return F.when(path.rlike(r"(?:\A|/)\.{0,2}(?:/|\z)"), F.regexp_replace(out, r"\A\z", ".")).otherwise(path)


def file_name(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"(?s)([^/]*)/*\z", 1), r"\A\z", ".")


def without_ext(path: Column) -> Column:
    """``path`` less the last extension, of whatever kind, of its last segment."""
    return F.regexp_replace(path, r"\.[^./]*\z", "")


def without_md(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)\.md\z", "")


def note_name(path: Column) -> Column:
    return without_ext(file_name(path))


def note_name_key(path: Column) -> Column:
    return lower(note_name(path))


def asset_name_key(path: Column) -> Column:
    return lower(file_name(path))


def folder(path: Column) -> Column:
    """The folder of a path as it is written, ``.`` at the root of the vault."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*\z", "")).otherwise(F.lit("."))


def joined(base: Column, target: Column) -> Column:
    return clean(F.concat(base, F.lit("/"), target))


def is_root(path: Column) -> Column:
    return ~path.contains("/")


def is_bare(target: Column) -> Column:
    return ~target.contains("/")


def is_relative(target: Column) -> Column:
    return target.startswith("./") | target.startswith("../")


def is_url(target: Column) -> Column:
    return target.startswith("http://") | target.startswith("https://")


def _outside(path: Column) -> Column:
    return (path == "..") | path.startswith("../")


def escapes(source: Column, target: Column, bare: Column, relative: Column) -> Column:
    """Whether a link's target lies outside the vault. Bare names never do; the rest is counted from the source's folder if relative, else from the root."""
    inside = bare | ~target.contains("..")
    return F.when(inside, F.lit(False)).when(relative, _outside(joined(folder(source), target))).otherwise(_outside(clean(F.regexp_replace(target, r"\A/", ""))))


def vault_path(source: Column, target: Column, relative: Column) -> Column:
    """Where a path link points, counted from the root. Only relative targets are cleaned."""
    return F.when(relative, joined(folder(source), target)).when(target.startswith("/"), F.regexp_replace(target, r"\A/", "")).otherwise(target)
