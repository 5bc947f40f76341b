"""Extraction: notes to link occurrences, one row each, in the order in which a reader meets them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import links
from linkloom.functions.frontmatter import frontmatter_tags
from linkloom.functions.paths import trim
from linkloom.runtime import ship

#: An occurrence's place in its note: the line above this many bits, its place in the line below. Frontmatter has line 0.
_LINE_BITS = 32
KINDS = frozenset({"wikilink", "markdown", "tag", "frontmatter"})
LINKS = frozenset({"wikilink", "markdown"})


def content_lines(content: Column) -> Column:
    return F.split(content, "\n", -1)


def frontmatter_end(lines: Column) -> Column:
    """The index from 0 of the line that closes the frontmatter; 0 if there is none."""
    rest = F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), trim)
    return F.when(trim(F.get(lines, F.lit(0))) == "---", F.array_position(rest, "---")).otherwise(F.lit(0)).cast("int")


def live_lines(notes: DataFrame) -> DataFrame:
    """(path, walk_ord, n, line) of the lines outside frontmatter and code fences that can hold a link or tag, numbered from 1.

    Fence marks and the end of the frontmatter bound the stretches that count: from the first bound to the second, from
    the third to the fourth and so on, a last fence without an end going to the end. So a note is gone through once,
    however many marks it has, and only the lines that are wanted become rows.
    """
    rows = notes.select("path", "walk_ord", content_lines(F.col("content")).alias("lines")).withColumn("end", frontmatter_end(F.col("lines")))
    marks = F.array_compact(F.transform("lines", lambda x, i: F.when(trim(x).startswith("```"), i + 1)))
    begin = F.when(F.col("end") > 0, F.col("end") + 1).otherwise(F.lit(0))
    bounds = F.concat(F.array(begin), F.filter(marks, lambda m: m > begin), F.array(F.size("lines") + 1))
    rows = rows.select("path", "walk_ord", "lines", bounds.alias("bounds"))
    inside = F.sequence(F.lit(1), F.floor(F.size("bounds") / 2).cast("int"))

    def stretch(k: Column) -> Column:
        a, z = F.element_at("bounds", 2 * k - 1), F.element_at("bounds", 2 * k)
        numbered = F.transform(F.slice(F.col("lines"), a + 1, F.greatest(z - a - 1, F.lit(0))), lambda x, i: F.struct((a + 1 + i).alias("n"), x.alias("line")))
        return F.filter(numbered, lambda x: x["line"].rlike(r"[\[#]"))

    return rows.select("path", "walk_ord", F.inline(F.flatten(F.transform(inside, stretch))))


def _of_line(line: Column, number: Column, for_conversion: bool, kinds: frozenset[str]) -> Column:
    ways = {"wikilink": links.wikilinks, "markdown": links.markdown_links, "tag": links.tags}
    found = [way(line, number) for kind, way in ways.items() if kind in kinds]
    if for_conversion:
        found.append(links.markdown_self_links(line, number))
    return F.concat(*found)


def _frontmatter_rows(notes: DataFrame) -> DataFrame:
    """Only notes with a frontmatter that speaks of tags go through Python, and only that part of them."""
    ship(notes.sparkSession)
    lines = content_lines(F.col("content"))
    heads = (
        notes.filter(F.col("content").rlike(r"(?s)\A[^\n]*---"))
        .select("path", "walk_ord", lines.alias("lines"))
        .withColumn("end", frontmatter_end(F.col("lines")))
        .filter("end > 0")
        .select("path", "walk_ord", F.array_join(F.slice(F.col("lines"), F.lit(2), F.greatest(F.col("end") - 1, F.lit(0))), "\n").alias("block"))
        .filter(F.col("block").contains("tags"))
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [
                (path, walk, tag, line, k)
                for path, walk, block in zip(*(c.to_pylist() for c in b.columns))
                for k, (tag, line) in enumerate(frontmatter_tags(block))
            ]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64()))], names=["path", "walk_ord", "tag", "line", "k"])

    found = heads.mapInArrow(read, "path string, walk_ord long, tag string, line int, k long")
    no = F.lit(False)
    return found.select(
        F.col("path").alias("src_path"), F.col("tag").alias("target"), no.alias("is_basename"), no.alias("is_relative"), F.lit("frontmatter").alias("link_type"),
        F.col("tag").alias("raw_link"), F.lit("").alias("subpath"), F.col("line").alias("line_start"), F.col("line").alias("line_end"), "walk_ord", F.col("k").alias("occ_ord"),
    )


def occurrences(notes: DataFrame, for_conversion: bool = False, kinds: frozenset[str] = KINDS) -> DataFrame:
    """One row per link occurrence of ``notes`` (path, content, walk_ord), of the ``kinds`` that are wanted. Null contents and paths give none.

    ``for_conversion`` adds Markdown links into their own note, which don't count as links elsewhere. ``occ_ord``
    is unique in a note and rises in reading order: frontmatter first, then by line, and in it wikilinks, Markdown
    links, tags. It is counted among the kinds that are wanted.
    """
    notes = notes.filter("path is not null and content is not null")
    if kinds == {"frontmatter"}:
        return _frontmatter_rows(notes)
    lines = live_lines(notes.filter(F.col("content").rlike(r"[\[#]"))).withColumn("line", links.without_code(F.col("line")))
    body = lines.select("path", "walk_ord", "n", F.posexplode(_of_line(F.col("line"), F.col("n"), for_conversion, kinds)).alias("k", "o"))
    found = body.select(
        F.col("path").alias("src_path"), "o.target", "o.is_basename", "o.is_relative", "o.link_type", "o.raw_link", "o.subpath",
        F.col("o.line").alias("line_start"), F.col("o.line").alias("line_end"), "walk_ord", (F.shiftleft(F.col("n").cast("long"), _LINE_BITS) + F.col("k")).alias("occ_ord"),
    )
    return found.unionByName(_frontmatter_rows(notes)) if "frontmatter" in kinds else found
