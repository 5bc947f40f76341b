import posixpath
import random
import re

import pytest
from pyspark.sql import functions as F

from linkloom.functions import links, paths
from linkloom.functions.globs import Excludes, check_globs, glob_regex


def test_clean_is_posix(spark):
    rng = random.Random(3)
    ps = ["/".join(rng.choice(["a", "b", ".", "..", "", "ü"]) for _ in range(rng.randint(1, 7))) for _ in range(800)]
    df = spark.createDataFrame([(p,) for p in ps], "p string")
    for r in df.select("p", paths.clean(F.col("p")).alias("c")).collect():
        want = posixpath.normpath(r.p) if r.p else "."
        assert r.c == re.sub(r"^//", "/", want), r.p


@pytest.mark.parametrize(
    "raw, kind, new, aim, want",
    [
        ("[[../A#h|x]]", "wikilink", "d/e/N.md", "A.md", "[[../../A#h|x]]"),
        ("[t](./B.md#h)", "markdown", "N.md", "d/B.md", "[t](./d/B.md#h)"),
        ("[t](./B)", "markdown", "d/N.md", "d/B.md", "[t](./B)"),
        ("[t](../i.png)", "markdown", "N.md", "i.png", "[t](./i.png)"),
    ],
)
def test_relative_again(raw, kind, new, aim, want):
    assert links._again(raw, kind, new, aim) == want


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "path, name, key, root",
    [("a/Note.v1.md", "Note.v1", "note.v1", False), ("X.MD", "X", "x", True), ("d/.md", "", "", False), ("d/noext", "noext", "noext", False)],
)
def test_names(spark, path, name, key, root):
    c = F.lit(path)
    assert one(spark, paths.note_name(c)) == name
    assert one(spark, paths.note_name_key(c)) == key
    assert one(spark, paths.is_root(c)) is root


@pytest.mark.parametrize(
    "source, target, out",
    [("a/b.md", "../x", False), ("a/b.md", "../../x", True), ("a.md", "../x", True), ("a.md", "sub/../../x", True), ("a.md", "/sub/../x", False), ("a.md", "x", False), ("a.md", "..", False)],
)
def test_escapes(spark, source, target, out):
    t = F.lit(target)
    assert one(spark, paths.escapes(F.lit(source), t, paths.is_bare(t), paths.is_relative(t))) is out


@pytest.mark.parametrize("pattern, text, hit", [("a/*", "a/b/c", True), ("a?c", "a港c", True), ("a?c", "ac", False), ("*.md", "x.mdx", False), ("A*", "ab", False), ("a.c", "abc", False), ("**", "", True)])
def test_globs(spark, pattern, text, hit):
    assert one(spark, F.lit(text).rlike(glob_regex(pattern))) is hit


def test_glob_class_is_an_error():
    with pytest.raises(ValueError):
        check_globs(["a[b]"])
    assert Excludes.merged(["x/*"], ["T"], [], ["#u"]) == Excludes(["x/*"], ["#t", "#u"])


@pytest.mark.parametrize(
    "raw, kind, path, want",
    [
        ("[[A#H|x]]", "wikilink", "d/B.md", "[[d/B#H|x]]"),
        ("[t](A.md#h)", "markdown", "d/B.md", "[t](d/B.md#h)"),
        ("[t](A)", "markdown", "d/B.md", "[t](d/B)"),
        ("[t](i.png)", "markdown", "d/i.png", "[t](d/i.png)"),
        ("[[A|b|c]]", "wikilink", "B", "[[B|b|c]]"),
    ],
)
def test_pointed_at(spark, raw, kind, path, want):
    assert one(spark, links.pointed_at(F.lit(raw), F.lit(kind), F.lit(path))) == want


@pytest.mark.parametrize("raw, want", [("[B](d/B.md)", "[[d/B]]"), ("[x](B.md#h)", "[[B#h|x]]"), ("[B#h](B.md#h)", "[[B#h]]"), ("[s](#s)", "[[#s|s]]"), ("[#s](#s)", "[[#s]]"), ("[w](http://a)", "[w](http://a)")])
def test_as_wikilink(spark, raw, want):
    assert one(spark, links.as_wikilink(F.lit(raw))) == want


@pytest.mark.parametrize("raw, note, want", [("[[d/B]]", True, "[B](d/B.md)"), ("[[B#h|x]]", True, "[x](B.md#h)"), ("[[i.png]]", False, "[i.png](i.png)"), ("[[#s]]", True, "[#s](#s)"), ("[[]]", True, "[[]]")])
def test_as_markdown(spark, raw, note, want):
    assert one(spark, links.as_markdown(F.lit(raw), F.lit(note))) == want


def test_code_is_left_alone(spark):
    line = F.lit("[[A]] `[[A]]` [[A]] `[[A]]")
    assert one(spark, links.replaced_outside_code(line, F.lit("[[A]]"), F.lit("[[B]]"))) == "[[B]] `[[A]]` [[B]] `[[A]]"


@pytest.mark.parametrize("raw, kind, bare", [("[[A]]", "wikilink", True), ("[[d/A]]", "wikilink", False), ("[[#h]]", "wikilink", False), ("[t](A.md)", "markdown", True), ("[t](#h)", "markdown", False)])
def test_bare_raw(spark, raw, kind, bare):
    assert one(spark, links.is_bare_raw(F.lit(raw), F.lit(kind))) is bare
