"""Whole commands on small folders: what the index and the texts look like afterwards."""

import itertools
import os

import pytest

from linkloom.operators import graph as G
from linkloom.operators.query import Entry, QueryError, resolve_link
from linkloom.sources.store import NoIndex
from linkloom.sources.vault import Vault, VaultError


def make(spark, root, files):
    for p, text in files.items():
        at = root / p
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(text.encode())
        os.utime(at, (1_700_000_000, 1_700_000_000))
    return Vault(spark, str(root))


def edges(v):
    return sorted((r.src_key, r.dst_key, r.raw_link) for r in v.store.read().edges.collect())


def keys(v):
    return sorted(r.node_key for r in v.store.read().nodes.collect())


FULL = {
    "A.md": "---\ntags: [t]\n---\n[[B]] [[sub/C]] [[Missing|m]] #x/y\n![[p.png]]",
    "B.md": "[[A#H]] [c](sub/C.md)\n[[#own]]",
    "sub/C.md": "[up](../A.md) [[missing]] #X/y",
    "img/p.png": "",
    "un.bin": "",
}


def test_build_and_query(spark, tmp_path):
    v = make(spark, tmp_path, FULL)
    with pytest.raises(NoIndex):
        v.stats()
    v.build()
    assert v.stats() == {"notes_total": 3, "notes_exists": 3, "tags_total": 3, "phantoms_total": 1, "assets_total": 2, "edges_total": 14}
    first = edges(v)
    v.build()
    assert edges(v) == first  # building twice changes nothing
    q = v.query(Entry(file="A.md"), head=1, snippet=0)
    assert [x["path"] for x in q["backlinks"]] == ["B.md", "sub/C.md"]
    assert [(x["type"], x["name"]) for x in q["outgoing"]] == [("phantom", "Missing"), ("note", "B"), ("asset", "p.png"), ("note", "C")]
    assert q["tags"] == ["#t", "#x/y"]
    assert q["head"] == ["[[B]] [[sub/C]] [[Missing|m]] #x/y"]
    assert {(t["via"]["name"], y["path"]) for t in q["twohop"] for y in t["targets"]} == {("C", "B.md"), ("Missing", "sub/C.md"), ("#x", "sub/C.md"), ("#x/y", "sub/C.md"), ("B", "B.md")}
    assert "backlinks" not in v.query(Entry(name="a"), ["tags"])
    s = v.query(Entry(phantom="MISSING"), ["snippet"], snippet=1)["snippets"]
    assert [(x["source"], x["line_start"], x["line_end"]) for x in s] == [("A.md", 3, 5), ("sub/C.md", 1, 1)]
    assert [t["via"]["path"] for t in v.query(Entry(tag="x"), ["twohop"])["twohop"]] == ["A.md", "sub/C.md"]
    assert v.resolve("B.md", "[[A#H]]") == {"type": "note", "name": "A", "path": "A.md", "exists": True, "subpath": "#H"}
    with pytest.raises(QueryError):
        v.resolve("sub/C.md", "[[B]]")
    with pytest.raises(QueryError):
        resolve_link(v.store.read(), "nope.md", "[[A]]")
    with pytest.raises(QueryError):
        v.query(Entry(file="A.md", tag="t"))
    ex = v.excludes(["sub/*"], ["T"])
    q = v.query(Entry(file="A.md"), ["backlinks", "tags", "outgoing"], ex=ex)
    assert [x["path"] for x in q["backlinks"]] == ["B.md"] and q["tags"] == ["#x/y"]
    assert ("phantom", "Missing") in [(x["type"], x["name"]) for x in q["outgoing"]]
    os.utime(tmp_path / "A.md", (1, 1))
    with pytest.raises(VaultError, match="stale"):
        v.query(Entry(file="A.md"), ["head"], head=3)


def test_build_errors(spark, tmp_path):
    v = make(spark, tmp_path, {"a/N.md": "", "b/N.md": "", "M.md": "[[N]] [x](../out.md)", "Z.md": "\n".join("[[n]]" for _ in range(9))})
    with pytest.raises(G.LinkError) as e:
        v.build()
    assert str(e.value).count("ambiguous link") == 4 and str(e.value).count("escapes") == 1
    (tmp_path / "N.md").write_text("")  # a file at the root settles the name
    (tmp_path / "M.md").write_text("[[N]]")
    v.build()
    assert ("note:path:M.md", "note:path:N.md", "[[N]]") in edges(v)
    assert v.diagnose()["basename_conflicts"] == [{"name": "N", "paths": ["N.md", "a/N.md", "b/N.md"]}]


def test_config_and_hidden(spark, tmp_path):
    v = make(spark, tmp_path, {"linkloom.yaml": "build:\n  exclude_paths: ['old/*']\n", "old/X.md": "", ".h/H.md": "", ".x.png": "", "A.MD": "[[X]] [[H]]"})
    v.build()
    assert keys(v) == ["asset:path:linkloom.yaml", "note:path:.h/H.md", "note:path:A.MD", "phantom:name:x"]


def test_update(spark, tmp_path):
    v = make(spark, tmp_path, {"A.md": "[[B]] #t", "B.md": "[[A]]", "C.md": "[[B]]"})
    v.build()
    (tmp_path / "A.md").write_text("[[New]] [[B]]")
    (tmp_path / "B.md").unlink()
    assert v.update(["A.md", "B.md"]) == {"updated": ["A.md"], "deleted": [], "phantomed": ["B.md"]}
    assert keys(v) == ["note:path:A.md", "note:path:C.md", "phantom:name:b", "phantom:name:new"]
    assert edges(v) == [("note:path:A.md", "phantom:name:b", "[[B]]"), ("note:path:A.md", "phantom:name:new", "[[New]]"), ("note:path:C.md", "phantom:name:b", "[[B]]")]
    with pytest.raises(VaultError):
        v.update(["nope.md"])


def test_add(spark, tmp_path):
    v = make(spark, tmp_path, {"A.md": "[[New]] [[sub/T]] [[T#x|y]] `[[T]]`", "sub/T.md": ""})
    v.build()
    (tmp_path / "d").mkdir()
    (tmp_path / "d/New.md").write_text("[[A]]")
    (tmp_path / "d/T.md").write_text("")
    with pytest.raises(VaultError, match="ambiguous"):
        v.add(["d/New.md", "d/T.md"], auto_disambiguate=False)
    out = v.add(["d/New.md", "d/T.md"])
    assert out["promoted"] == ["d/New.md"]
    assert out["rewritten"] == [{"file": "A.md", "old": "[[T#x|y]]", "new": "[[sub/T#x|y]]"}]
    assert (tmp_path / "A.md").read_text() == "[[New]] [[sub/T]] [[sub/T#x|y]] `[[T]]`"
    assert ("note:path:A.md", "note:path:sub/T.md", "[[sub/T#x|y]]") in edges(v)
    assert ("note:path:A.md", "note:path:d/New.md", "[[New]]") in edges(v)
    with pytest.raises(VaultError, match="registered"):
        v.add(["A.md"])


def test_delete_and_remove(spark, tmp_path):
    v = make(spark, tmp_path, {"A.md": "[[B]]", "B.md": "", "d/C.md": "", "d/x.bin": ""})
    v.build()
    with pytest.raises(VaultError, match="still exists"):
        v.delete(["B.md"])
    assert v.delete(["B.md", "d"], remove_files=True) == {"deleted": ["d/C.md", "d/x.bin"], "phantomed": ["B.md"]}
    assert keys(v) == ["note:path:A.md", "phantom:name:b"] and not (tmp_path / "d").exists()


def test_move_file(spark, tmp_path):
    v = make(spark, tmp_path, {"A.md": "[[B]] [x](./B.md) [[C]]", "B.md": "[[C]] [a](./A.md)", "C.md": "", "sub/K.md": "[[B]]"})
    v.build()
    out = v.move("B.md", "sub/D.md")["rewritten"]
    assert (tmp_path / "A.md").read_text() == "[[sub/D]] [x](sub/D.md) [[C]]"
    assert (tmp_path / "sub/D.md").read_text() == "[[C]] [a](../A.md)"
    assert (tmp_path / "sub/K.md").read_text() == "[[sub/D]]"
    assert len(out) == 4
    assert ("note:path:sub/D.md", "note:path:A.md", "[a](../A.md)") in edges(v)
    assert not any("B.md" in x for e in edges(v) for x in e)
    for bad in (("sub/D.md", "sub/D.md"), ("nope.md", "x.md"), ("A.md", "C.md"), ("A.md", "../A.md")):
        with pytest.raises(VaultError):
            v.move(*bad)


def test_move_collateral(spark, tmp_path):
    # a second file of the name makes bare links to the first unclear
    v = make(spark, tmp_path, {"d/T.md": "", "e/U.md": "", "A.md": "[[T]] [[U]]"})
    v.build()
    v.move("e/U.md", "e/T.md")
    assert (tmp_path / "A.md").read_text() == "[[d/T]] [[e/T]]"
    assert {e[1] for e in edges(v)} == {"note:path:d/T.md", "note:path:e/T.md"}


def test_move_folder(spark, tmp_path):
    v = make(spark, tmp_path, {"o/A.md": "[b](./B.md) [[../R]] [[o/B]]", "o/B.md": "", "R.md": "[[o/A]] [[B]]", "o/raw.png": ""})
    v.build()
    out = v.move("o", "n/m")
    assert [x["to"] for x in out["moved"]] == ["n/m/A.md", "n/m/B.md", "n/m/raw.png"]
    assert (tmp_path / "n/m/A.md").read_text() == "[b](./B.md) [[../../R]] [[n/m/B]]"
    assert (tmp_path / "R.md").read_text() == "[[n/m/A]] [[B]]"
    assert not (tmp_path / "o").exists()
    assert ("note:path:R.md", "note:path:n/m/A.md", "[[n/m/A]]") in edges(v)
    with pytest.raises(VaultError, match="overlap"):
        v.move("n/m", "n/m/x")


def test_moved_by_hand(spark, tmp_path):
    v = make(spark, tmp_path, {"A.md": "[[d/B]]", "d/B.md": ""})
    v.build()
    os.rename(tmp_path / "d/B.md", tmp_path / "B2.md")
    v.move("d/B.md", "B2.md")
    assert (tmp_path / "A.md").read_text() == "[[B2]]"


def test_simplify_and_repair(spark, tmp_path):
    v = make(
        spark,
        tmp_path,
        {"A.md": "[[d/U]] [[d/S]] [u](d/U.md#h) [i](d/i.png) [[e/R]] [[x/y/U]] [[q/S]] [[no/W]] [o](../../out.md)", "d/U.md": "", "d/S.md": "", "e/S.md": "", "d/i.png": "", "R.md": "", "e/R.md": ""},
    )
    out = v.simplify(dry_run=True)
    assert [(r["old"], r["new"]) for r in out["rewritten"]] == [("[[d/U]]", "[[U]]"), ("[u](d/U.md#h)", "[u](U.md#h)"), ("[i](d/i.png)", "[i](i.png)")]
    assert out["skipped"] == [{"file": "A.md", "raw_link": "[[d/S]]", "basename": "S", "candidates": ["d/S.md", "e/S.md"]}]
    out = v.repair()
    assert [(r["old"], r["new"]) for r in out["rewritten"]] == [("[[x/y/U]]", "[[U]]"), ("[[no/W]]", "[[W]]"), ("[o](../../out.md)", "[o](out.md)")]
    assert [s["raw_link"] for s in out["skipped"]] == ["[[q/S]]"]
    assert "[i](d/i.png)" in (tmp_path / "A.md").read_text()


def test_convert_there_and_back(spark, tmp_path):
    text = "[[B]] [[d/B#h|x]] ![[i.png]] `[[B]]` [[#s]]\n```\n[[B]]\n```\n"
    v = make(spark, tmp_path, {"A.md": text, "B.md": "", "d/B.md": "", "i.png": ""})
    v.convert("markdown")
    assert (tmp_path / "A.md").read_text() == "[B](B.md) [x](d/B.md#h) ![i.png](i.png) `[[B]]` [#s](#s)\n```\n[[B]]\n```\n"
    v.convert("wikilink")
    assert (tmp_path / "A.md").read_text() == text
    with pytest.raises(VaultError):
        v.convert("markdown", ["nope.md"])


def test_disambiguate(spark, tmp_path):
    files = {"A.md": "[[T]] [[gone/T]] [x](T.md)", "T.md": "[[T]]", "d/T.md": ""}
    v = make(spark, tmp_path, files)
    v.build()
    with pytest.raises(ValueError, match="required"):
        v.disambiguate("T")
    assert [(r["old"], r["new"]) for r in v.disambiguate("T", "d/T", scan=True)["rewritten"]] == [("[[T]]", "[[d/T]]"), ("[[gone/T]]", "[[d/T]]"), ("[x](T.md)", "[x](d/T.md)"), ("[[T]]", "[[d/T]]")]
    v = make(spark, tmp_path / "two", files)
    v.build()
    assert {r["new"] for r in v.disambiguate("T", "d/T")["rewritten"]} == {"[[d/T]]"}  # only what the phantom holds


def test_delete_order(spark):
    """Files taken away one by one against the set-based rule, over all orders of a small graph."""
    links = [("a", "b"), ("b", "a"), ("c", "b"), ("a", "a"), ("d", "c")]
    nodes = [(f"note:path:{x}", "note", x, x, True, 1, i) for i, x in enumerate("abcd")]
    from linkloom.schema import EDGES, NODES

    g = G.Graph(
        spark.createDataFrame(nodes, NODES).cache(),
        spark.createDataFrame([(f"note:path:{s}", f"note:path:{t}", "wikilink", "[[x]]", "", 1, 1, i) for i, (s, t) in enumerate(links)], EDGES).cache(),
    )
    for order in itertools.islice(itertools.permutations("abcd", 3), 0, 24, 3):
        live, want = list(links), {}
        for x in order:
            want[x] = any(t == x and s != x for s, t in live)
            live = [(s, t) for s, t in live if s != x]
        _, facts = G.removed(g, spark.createDataFrame([(f"note:path:{x}", i) for i, x in enumerate(order)], "node_key string, pos long"))
        assert {r.path: r.phantomed for r in facts.collect()} == want
