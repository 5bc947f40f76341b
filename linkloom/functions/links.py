"""Link syntax as Column expressions: finding links in a line, taking raw links apart, writing them anew."""

from __future__ import annotations

import posixpath

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions.paths import WS, file_name, is_bare, is_relative, is_url, lower, trim, without_md

#: The signs that end a tag, beside white space.
_NOT_TAG = r"\x{00}-\x{20}" + WS + r"'\"!#$%&()*+,.:;<=>?@^{|}~\[\]\\`\x{2000}-\x{206F}\x{2E00}-\x{2E7F}"
_TAG = rf"(?<![^{WS}])#([^{_NOT_TAG}\p{{Nd}}/][^{_NOT_TAG}]*)"
_CODE = r"`[^`]*(?:`|\z)"


def _occurrence(target: Column, bare: Column, relative: Column, kind: str, raw: Column, subpath: Column, line: Column) -> Column:
    return F.struct(
        target.alias("target"),
        bare.alias("is_basename"),
        relative.alias("is_relative"),
        F.lit(kind).alias("link_type"),
        raw.alias("raw_link"),
        subpath.alias("subpath"),
        line.cast("int").alias("line"),
    )


def without_code(line: Column) -> Column:
    return F.regexp_replace(line, _CODE, "")


def before_alias(inner: Column) -> Column:
    return F.substring_index(inner, "|", 1)


def target_part(text: Column) -> Column:
    return F.substring_index(text, "#", 1)


def subpath_part(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)(#.*)\z", 1)


def alias_part(inner: Column) -> Column:
    """The alias with its bar, or nothing."""
    return F.regexp_extract(inner, r"(?s)\A[^|]*(\|.*)\z", 1)


def wikilinks(line: Column, number: Column) -> Column:
    def one(inner: Column) -> Column:
        name = before_alias(inner)
        target, sub = target_part(name), subpath_part(name)
        own = target == ""
        return _occurrence(without_md(target), ~own & is_bare(target), is_relative(target), "wikilink", F.concat(F.lit("[["), inner, F.lit("]]")), sub, number)

    found = F.regexp_extract_all(line, F.lit(r"(?s)\[\[(.*?)\]\]"), 1)
    return F.filter(F.transform(found, one), lambda x: (x["target"] != "") | (x["subpath"] != "") | x["is_basename"])


def _markdown(line: Column) -> Column:
    return F.filter(F.regexp_extract_all(line, F.lit(r"(?s)\[\[|\[.*?\]\(.*?\)"), 0), lambda x: x != "[[")


def url_part(raw: Column) -> Column:
    return F.regexp_extract(raw, r"(?s)\A.*?\]\((.*?)\)?\z", 1)


def markdown_links(line: Column, number: Column) -> Column:
    def one(raw: Column) -> Column:
        url = trim(url_part(raw))
        target = target_part(url)
        return _occurrence(without_md(target), is_bare(target), is_relative(target), "markdown", raw, subpath_part(url), number)

    live = F.filter(_markdown(line), lambda r: (target_part(trim(url_part(r))) != "") & ~is_url(trim(url_part(r))))
    return F.transform(live, one)


def markdown_self_links(line: Column, number: Column) -> Column:
    """``[text](#heading)``, which only the conversion of links looks at."""
    own = F.filter(_markdown(line), lambda r: trim(url_part(r)).startswith("#"))
    return F.transform(own, lambda r: _occurrence(F.lit(""), F.lit(False), F.lit(False), "markdown", r, trim(url_part(r)), number))


def tags(line: Column, number: Column) -> Column:
    """Inline tags of a line that isn't a heading, each with its ancestors before it."""
    bare = F.regexp_replace(F.regexp_replace(line, r"(?s)\[.*?\]\(.*?\)", ""), r"(?s)\[\[.*?\]\]", "")
    heading = trim(bare).startswith("# ") | (trim(bare) == "#")

    def spread(name: Column) -> Column:
        parts = F.filter(F.split(F.regexp_replace(name, r"/+\z", ""), "/"), lambda p: p != "")
        ways = F.transform(parts, lambda p, i: F.concat(F.lit("#"), F.array_join(F.slice(parts, F.lit(1), i + 1), "/")))
        return F.transform(ways, lambda t: _occurrence(t, F.lit(False), F.lit(False), "tag", t, F.lit(""), number))

    found = F.flatten(F.transform(F.regexp_extract_all(bare, F.lit(_TAG), 1), spread))
    return F.when(heading, F.filter(found, lambda x: F.lit(False))).otherwise(found)


def wiki_inner(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(raw, r"\A\[\[", ""), r"\]\]\z", "")


def is_bare_raw(raw: Column, kind: Column) -> Column:
    """Whether a raw link names its target without a path; a link into its own note doesn't."""
    target = F.when(kind == "wikilink", target_part(before_alias(wiki_inner(raw)))).otherwise(target_part(url_part(raw)))
    return (target != "") & ~target.contains("/") & (kind.isin("wikilink") | raw.contains("]("))


def pointed_at(raw: Column, kind: Column, path: Column) -> Column:
    """``raw`` with ``path`` as its target; alias, heading, text and the presence of ``.md`` in a Markdown link stay."""
    inner = wiki_inner(raw)
    wiki = F.concat(F.lit("[["), without_md(path), subpath_part(before_alias(inner)), alias_part(inner), F.lit("]]"))
    url = url_part(raw)
    md = F.when(lower(target_part(url)).endswith(".md"), F.lit(".md")).otherwise(F.lit(""))
    mark = F.concat(F.regexp_extract(raw, r"(?s)\A(.*?\]\()", 1), without_md(path), md, subpath_part(url), F.lit(")"))
    return F.when(kind == "wikilink", wiki).when((kind == "markdown") & raw.contains("]("), mark).otherwise(raw)


def raw_target(raw: Column, kind: Column) -> Column:
    return F.when(kind == "wikilink", target_part(before_alias(wiki_inner(raw)))).otherwise(target_part(url_part(raw)))


def _again(raw: str, kind: str, new_path: str, aim: str) -> str:
    way = posixpath.relpath("/" + aim, "/" + posixpath.dirname(new_path))
    way = way if way.startswith("..") else f"./{way}"
    if kind == "wikilink":
        name, bar, alias = raw.removeprefix("[[").removesuffix("]]").partition("|")
        _, mark, heading = name.partition("#")
        return f"[[{way.removesuffix('.md')}{mark}{heading}{bar}{alias}]]"
    text, mid, url = raw.partition("](")
    if not mid:
        return raw
    target, mark, heading = url.removesuffix(")").partition("#")
    kept = way.removesuffix(".md") if not target.lower().endswith(".md") else way if way.lower().endswith(".md") else f"{way}.md"
    return f"{text}]({kept}{mark}{heading})"


def relative_again(raw: Column, kind: Column, new_path: Column, aim: Column) -> Column:
    """A relative raw link as it must read from ``new_path`` for ``aim``, a clean path from the root.

    Only the relative links of moved notes get here, so these few rows may go through Arrow.
    """

    @F.pandas_udf("string")
    def again(r: pd.Series, k: pd.Series, n: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series([_again(*x) for x in zip(r, k, n, a)], dtype="object")

    return again(raw, kind, new_path, aim)


def as_wikilink(raw: Column) -> Column:
    """A Markdown link as a wikilink; one to the web stays."""
    url = url_part(raw)
    text = F.regexp_extract(raw, r"(?s)\A\[(.*?)\]\(", 1)
    target, sub = target_part(url), subpath_part(url)
    own = F.when(text == sub, F.concat(F.lit("[["), sub, F.lit("]]"))).otherwise(F.concat(F.lit("[["), sub, F.lit("|"), text, F.lit("]]")))
    path = without_md(target)
    name = file_name(path)
    plain = (text == name) | ((sub != "") & (text == F.concat(name, sub)))
    full = F.concat(F.lit("[["), path, sub, F.when(plain, F.lit("")).otherwise(F.concat(F.lit("|"), text)), F.lit("]]"))
    empty = ((text == "") & (url == "")) | is_url(url)
    return F.when(empty, raw).when((target == "") & (sub != ""), own).otherwise(full)


def as_markdown(raw: Column, is_note: Column) -> Column:
    """A wikilink as a Markdown link; ``is_note`` tells whether the target wants ``.md``."""
    inner = wiki_inner(raw)
    alias = F.regexp_replace(alias_part(inner), r"\A\|", "")
    name = before_alias(inner)
    target, sub = target_part(name), subpath_part(name)
    text = F.when(alias != "", alias).when(target == "", sub).otherwise(F.concat(file_name(target), sub))
    md = F.when(is_note & ~lower(target).endswith(".md"), F.concat(target, F.lit(".md"))).otherwise(target)
    url = F.when((target == "") & (sub != ""), sub).otherwise(F.concat(md, sub))
    return F.when(inner == "", raw).otherwise(F.concat(F.lit("["), text, F.lit("]("), url, F.lit(")")))


def has_ext(target: Column) -> Column:
    return F.regexp_extract(target, r"(\.[^./]*)\z", 1) != ""


def replaced_outside_code(line: Column, old: Column, new: Column) -> Column:
    """``old`` replaced by ``new`` wherever it isn't within backticks."""
    parts = F.regexp_extract_all(line, F.lit(r"(?s)`[^`]*(?:`|\z)|[^`]+"), 0)
    return F.array_join(F.transform(parts, lambda p: F.when(p.startswith("`"), p).otherwise(F.replace(p, old, new))), "")
