"""Column extraction against a plain scanner of the same rules, on fixed cases and on random lines."""

import random
import re

from linkloom.functions.frontmatter import frontmatter_tags
from linkloom.operators.extract import occurrences

SPACE = "\t\n\x0b\f\r \x85\xa0                　"


def rows_of(spark, text):
    df = spark.createDataFrame([("d/n.md", text, 0)], "path string, content string, walk_ord long")
    return [(r.link_type, r.target, r.subpath, r.raw_link, r.line_start) for r in occurrences(df).orderBy("occ_ord").collect()]


def test_forms(spark):
    text = (
        "---\ntags: [a/b, c]\n---\n[[X]] [[sub/Y.md#H|alias]] [[#own]] [t](./z.md) [w](https://x.y)\n"
        "`[[code]]` #one/two #1no #\n# head #no\n## sub #yes\n```\n[[fenced]] #no\n```\n[[after]] [t](#own)"
    )
    assert rows_of(spark, text) == [
        ("frontmatter", "#a", "", "#a", 2),
        ("frontmatter", "#a/b", "", "#a/b", 2),
        ("frontmatter", "#c", "", "#c", 2),
        ("wikilink", "X", "", "[[X]]", 4),
        ("wikilink", "sub/Y", "#H", "[[sub/Y.md#H|alias]]", 4),
        ("wikilink", "", "#own", "[[#own]]", 4),
        ("markdown", "./z", "", "[t](./z.md)", 4),
        ("tag", "#one", "", "#one", 5),
        ("tag", "#one/two", "", "#one/two", 5),
        ("tag", "#yes", "", "#yes", 7),
        ("wikilink", "after", "", "[[after]]", 11),
    ]


def test_frontmatter_forms():
    assert frontmatter_tags('tags: "x, #y"') == [("#x", 2), ("#y", 2)]
    assert frontmatter_tags("a: 1\ntags:\n  - p//q\n  - r") == [("#p", 4), ("#p/", 4), ("#p//q", 4), ("#r", 5)]
    assert frontmatter_tags("tags: [unclosed") == []
    assert frontmatter_tags("- list") == []
    assert frontmatter_tags("other:\n  tags: no") == []


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([("a.md", None, 0), (None, "[[x]]", 1), ("b.md", "", 2), ("c.md", "---\n", 3), ("d.md", "---\n---", 4)], "path string, content string, walk_ord long")
    assert occurrences(df).count() == 0


def scan(line):
    """(type, target, raw) of a line by plain scanning."""
    clean = re.sub(r"`[^`]*(`|$)", "", line, flags=re.S)
    out, rest = [], clean
    while (a := rest.find("[[")) >= 0 and (z := rest.find("]]", a + 2)) >= 0:
        inner = rest[a + 2 : z]
        name = inner.split("|")[0]
        target, sep, _ = name.partition("#")
        if target or sep:
            out.append(("wikilink", re.sub(r"(?i)\.md\Z", "", target), f"[[{inner}]]"))
        rest = rest[z + 2 :]
    rest = clean
    while (a := rest.find("[")) >= 0:
        if rest[a + 1 : a + 2] == "[":
            rest = rest[a + 2 :]
            continue
        m = rest.find("](", a)
        z = rest.find(")", m + 2) if m >= 0 else -1
        if z < 0:
            break
        url = rest[m + 2 : z].strip(SPACE)
        target = url.split("#")[0]
        if target and not url.startswith(("http://", "https://")):
            out.append(("markdown", re.sub(r"(?i)\.md\Z", "", target), rest[a : z + 1]))
        rest = rest[z + 1 :]
    return out


def test_random_lines(spark):
    rng = random.Random(7)
    parts = ["[[", "]]", "[", "](", ")", "|", "#", "`", "a", "B.md", "./", "/", " ", "\r", "\x85", "　", "港", "http://x"]
    lines = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    df = spark.createDataFrame([(f"{i:05d}", x, i) for i, x in enumerate(lines)], "path string, content string, walk_ord long")
    got = {}
    for r in occurrences(df).filter("link_type in ('wikilink', 'markdown')").orderBy("src_path", "occ_ord").collect():
        got.setdefault(int(r.src_path), []).append((r.link_type, r.target, r.raw_link))
    for i, x in enumerate(lines):
        want = [] if x.strip(SPACE).startswith("```") else scan(x)
        assert got.get(i, []) == want, x
