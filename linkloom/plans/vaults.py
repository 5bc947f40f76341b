"""Commands on a vault of files that is written from the small tables, and what index and texts are like afterwards."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.cli import run
from linkloom.operators.query import Entry
from linkloom.runtime import shared_dir, table
from linkloom.sources import files as FS
from linkloom.sources.vault import Vault

#: Vaults by application, folder of tables and what was done to them; each command works on a copy of the built one.
_DONE: dict[tuple[str, str, str], Vault] = {}


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared one, which must be mounted, as commands on files work with paths."""
    base = shared_dir(spark)
    if base.startswith("file:"):
        base = "/" + base.removeprefix("file:").lstrip("/")
    at = os.path.join(base, "linkloom", f"vault-{uuid.uuid4().hex}")
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    return at


def world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content) of notes on regions, nations, suppliers and customers, and of pictures of every other nation."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("nm"), F.col("n_regionkey").alias("rk"))
    note = lambda rows, path, text: rows.select(F.format_string(*path).alias("path"), F.format_string(*text).alias("content"))
    supplier = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("k"))
    customer = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("k"))
    return (
        note(table(spark, sf_dir, "region"), ("regions/R%d.md", "r_regionkey"), ("# region\n",))
        .unionByName(note(nation, ("nations/%s.md", "nm"), ("---\ntags: [nation, area/r%d]\n---\n[[R%d]] and [map](../img/%s.png)\n", "rk", "rk", "nm")))
        .unionByName(note(nation.filter("k % 2 = 0"), ("img/%s.png", "nm"), ("",)))
        .unionByName(
            note(supplier, ("suppliers/s%d.md", "s_suppkey"), ("[[%s]] [[/regions/R%d|home]] [[old/%s]]\n```\n[[NATION_0]]\n```\n#kind/supplier `[[R0]]` [[.hidden/x.png]]\n", "nm", "rk", "nm"))
        )
        .unionByName(note(customer, ("customers/c%d.md", "c_custkey"), ("[nation](../nations/%s.md#top)\n[[Segment %s]]\n", "nm", "c_mktsegment")))
    )


def _vault(spark: SparkSession, sf_dir: str) -> Vault:
    """A built vault of its own."""
    key = (spark.sparkContext.applicationId, sf_dir, "build")
    if key not in _DONE:
        root = _folder(spark)
        FS.create(root, world(spark, sf_dir).unionByName(spark.createDataFrame([(".hidden/x.png", "")], "path string, content string")))
        _DONE[key] = Vault(spark, root)
        _DONE[key].build()
    at = _folder(spark)
    FS.copy(spark, _DONE[key].root, at)
    return Vault(spark, at)


def _edges(v: Vault) -> DataFrame:
    return v.store.read().edges.select("src_key", "dst_key", "link_type", "raw_link", F.col("line_start").alias("line"))


def _nodes(v: Vault) -> DataFrame:
    return v.store.read().nodes.select("node_key", "type", "name", "path", "exists_flag")


def _texts(v: Vault) -> DataFrame:
    return FS.read_notes(v.spark, v.root, FS.notes_in(v.spark, v.root).withColumn("walk_ord", F.lit(0).cast("long"))).select("path", "content")


def _added(v: Vault) -> None:
    """Second notes with the names of the regions, and notes for the phantoms of segments."""
    segments = sorted(r.name for r in v.store.read().nodes.filter("type = 'phantom' and name like 'Segment %'").collect())
    regions = [r.path.rsplit("/", 1)[1] for r in FS.notes_in(v.spark, v.root).filter("path like 'regions/%'").orderBy("path").collect()]
    new = [f"extra/{n}" for n in regions] + [f"extra/{s}.md" for s in segments]
    FS.create(v.root, v.spark.createDataFrame([(p, "[[NATION_1]]\n") for p in new], "path string, content string"))
    v.add(new)


def _updated(v: Vault) -> None:
    """Suppliers with other texts, customers with an even number gone."""
    notes = FS.notes_in(v.spark, v.root)
    suppliers = notes.filter("path like 'suppliers/%'")
    gone = notes.filter("path like 'customers/%' and cast(regexp_extract(path, '([0-9]+)[.]md$', 1) as long) % 2 = 0")
    FS.create(v.root, suppliers.withColumn("content", F.lit("[[R0]] #kind/other\n")))
    FS.remove(v.root, gone)
    v.update(FS.ranked(suppliers.unionByName(gone), F.array(F.when(F.col("path").like("suppliers/%"), "0").otherwise("1"), "path")).withColumnRenamed("walk_ord", "pos"))


def _after(name: str, show: Callable[[Vault], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """What ``show`` shows after a change, which is made once for all that show it."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, f"after {name}")
        if key not in _DONE:
            v = _vault(spark, sf_dir)
            _CHANGES[name](v)
            _DONE[key] = v
        return show(_DONE[key])

    return query


def vault_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, pos, value) of what a query of one nation shows."""
    q = _vault(spark, sf_dir).query(Entry(name="nation_0"), ["backlinks", "outgoing", "tags", "head"], head=1)
    rows = [(f, i, x if isinstance(x, str) else x["path"] or x["name"]) for f in ("backlinks", "outgoing", "tags", "head") for i, x in enumerate(q[f])]
    return spark.createDataFrame([("entry", 0, q["entry"]["path"]), *rows], "field string, pos int, value string")


def vault_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vault(spark, sf_dir)
    asked = [("nations/NATION_0.md", "[[R0]]"), ("nations/NATION_0.md", "[map](../img/NATION_0.png)"), ("nations/NATION_1.md", "[map](../img/NATION_1.png)"), ("suppliers/s0.md", "#kind/supplier")]
    rows = [(s, link, *(r[k] for k in ("type", "name", "path", "subpath"))) for s, link in asked for r in [v.resolve(s, link)]]
    return spark.createDataFrame(rows, "source string, link string, type string, name string, path string, subpath string")


def vault_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(command, message) of commands that can't be carried out."""
    v = _vault(spark, sf_dir)
    calls: dict[str, Callable[[], object]] = {
        "add known": lambda: v.add(["regions/R0.md"]),
        "add absent": lambda: v.add(["zzz.md"]),
        "update unknown": lambda: v.update(["zzz.md"]),
        "delete present": lambda: v.delete(["regions/R0.md"]),
        "move to itself": lambda: v.move("regions/R0.md", "regions/./R0.md"),
        "move out": lambda: v.move("regions/R0.md", "../R0.md"),
        "move to known": lambda: v.move("regions/R0.md", "regions/R1.md"),
        "move unknown": lambda: v.move("zzz.md", "yyy.md"),
        "query file": lambda: v.query(Entry(file="zzz.md")),
        "query tag": lambda: v.query(Entry(tag="zzz")),
        "query two": lambda: v.query(Entry(file="zzz.md", tag="zzz")),
        "resolve source": lambda: v.resolve("zzz.md", "[[R0]]"),
        "resolve link": lambda: v.resolve("nations/NATION_0.md", "[[NATION_1]]"),
        "disambiguate": lambda: v.disambiguate("zzz"),
        "convert": lambda: v.convert("html"),
    }
    rows = []
    for name, call in calls.items():
        try:
            call()
        except ValueError as e:
            rows.append((name, str(e)))
    return spark.createDataFrame(rows, "command string, message string")


_COMMANDS = {
    "stats": ["stats"],
    "stats of some": ["stats", "--format", "json", "--fields", "assets_total,notes_total"],
    "resolve": ["resolve", "--from", "nations/NATION_0.md", "--link", "[[R0]]"],
    "resolve some": ["resolve", "--from", "nations/NATION_0.md", "--link", "[map](../img/NATION_0.png)", "--fields", "exists,path"],
    "resolve phantom": ["resolve", "--from", "nations/NATION_1.md", "--link", "[map](../img/NATION_1.png)", "--format", "json"],
    "query": ["query", "--file", "nations/NATION_0.md", "--fields", "outgoing,tags,head", "--include-head", "1"],
    "diagnose": ["diagnose", "--fields", "basename_conflicts,asset_basename_conflicts"],
    "convert": ["convert", "--to", "markdown", "--dry-run", "--format", "json", "--file", "regions/R0.md"],
    "disambiguate": ["disambiguate", "--name", "R0"],
}


def vault_cli(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(command, pos, line) of what the command line prints."""
    v = _vault(spark, sf_dir)
    rows = [(name, i, line) for name, args in _COMMANDS.items() for i, line in enumerate(run(spark, [*args, "--vault", v.root]).split("\n"))]
    return spark.createDataFrame(rows, "command string, pos int, line string")


_CHANGES: dict[str, Callable[[Vault], object]] = {
    "build": lambda v: None,
    "add": _added,
    "update": _updated,
    "delete": lambda v: v.delete(["nations/"], remove_files=True),
    "move": lambda v: v.move("nations", "world/nations"),
    "repair": lambda v: v.repair(),
    "simplify": lambda v: v.simplify(),
    "convert": lambda v: v.convert("wikilink"),
    "disambiguate": lambda v: v.disambiguate("R0"),
}
_SHOWN_AFTER = {"nodes": (_nodes, "build add update delete move"), "edges": (_edges, "build add update delete move"), "texts": (_texts, "add move repair simplify convert disambiguate")}
QUERIES = {f"vault_{change}_{what}": _after(change, show) for what, (show, changes) in _SHOWN_AFTER.items() for change in changes.split()} | {
    "vault_query": vault_query,
    "vault_resolve": vault_resolve,
    "vault_errors": vault_errors,
    "vault_cli": vault_cli,
}

_BASE = """WITH nat AS (SELECT n_nationkey k, n_name nm, n_regionkey rk FROM nation),
sup AS (SELECT s_suppkey sk, nm, rk FROM supplier JOIN nat ON k = s_nationkey),
cus AS (SELECT c_custkey ck, nm, c_mktsegment seg FROM customer JOIN nat ON k = c_nationkey)"""
_NAT_TEXT = "'---' || chr(10) || 'tags: [nation, area/r' || rk || ']' || chr(10) || '---' || chr(10) || {} || ' and ' || {} || chr(10)"
_SUP_TEXT = "{} || ' ' || {} || ' ' || {} || chr(10) || '```' || chr(10) || '[[NATION_0]]' || chr(10) || '```' || chr(10) || '#kind/supplier `[[R0]]` [[.hidden/x.png]]' || chr(10)"
_CUS_TEXT = "{} || chr(10) || '[[Segment ' || seg || ']]' || chr(10)"
_R, _MAP, _NM, _HOME, _OLD, _BACK = "'[[R' || rk || ']]'", "'[map](../img/' || nm || '.png)'", "'[[' || nm || ']]'", "'[[/regions/R' || rk || '|home]]'", "'[[old/' || nm || ']]'", "'[nation](../nations/' || nm || '.md#top)'"


def _sql_texts(r: str = _R, pic: str = _MAP, home: str = _HOME, old: str = _OLD, back: str = _BACK, folder: str = "nations", more: str = "") -> str:
    return f"""{_BASE} SELECT 'regions/R' || r_regionkey || '.md' AS path, '# region' || chr(10) AS content FROM region
UNION ALL SELECT '{folder}/' || nm || '.md', {_NAT_TEXT.format(r, pic)} FROM nat
UNION ALL SELECT 'suppliers/s' || sk || '.md', {_SUP_TEXT.format(_NM, home, old)} FROM sup
UNION ALL SELECT 'customers/c' || ck || '.md', {_CUS_TEXT.format(back)} FROM cus {more}"""


def _sql_edges(folder: str = "nations", r: str = _R, pic: str = _MAP, back: str = _BACK, nation: str | None = None, segment: str = "'phantom:name:segment ' || lower(seg)", nations: str = "true", suppliers: str = "true", customers: str = "true", more: str = "", old: str = "'phantom:name:' || lower(nm)") -> str:
    to = nation or f"'note:path:{folder}/' || nm || '.md'"
    n, s, c = f"'note:path:{folder}/' || nm || '.md'", "'note:path:suppliers/s' || sk || '.md'", "'note:path:customers/c' || ck || '.md'"
    return f"""{_BASE}, x AS (
SELECT {n} AS src_key, 'tag:name:' || t AS dst_key, 'frontmatter' AS link_type, t AS raw_link, 2 AS line FROM (SELECT *, unnest(['#nation', '#area', '#area/r' || rk]) t FROM nat) WHERE {nations}
UNION ALL SELECT {n}, 'note:path:regions/R' || rk || '.md', 'wikilink', {r}, 4 FROM nat WHERE {nations}
UNION ALL SELECT {n}, CASE WHEN k % 2 = 0 THEN 'asset:path:img/' || nm || '.png' ELSE 'phantom:name:' || lower(nm) || '.png' END, 'markdown', {pic}, 4 FROM nat WHERE {nations}
UNION ALL SELECT {s}, {to}, 'wikilink', {_NM}, 1 FROM sup WHERE {suppliers}
UNION ALL SELECT {s}, 'note:path:regions/R' || rk || '.md', 'wikilink', {_HOME}, 1 FROM sup WHERE {suppliers}
UNION ALL SELECT {s}, {old}, 'wikilink', {_OLD}, 1 FROM sup WHERE {suppliers}
UNION ALL SELECT {s}, 'phantom:name:x.png', 'wikilink', '[[.hidden/x.png]]', 5 FROM sup WHERE {suppliers}
UNION ALL SELECT {s}, 'tag:name:' || t, 'tag', t, 5 FROM (SELECT *, unnest(['#kind', '#kind/supplier']) t FROM sup) WHERE {suppliers}
UNION ALL SELECT {c}, {to}, 'markdown', {back}, 1 FROM cus WHERE {customers}
UNION ALL SELECT {c}, {segment}, 'wikilink', '[[Segment ' || seg || ']]', 2 FROM cus WHERE {customers}
{more})"""


def _sql_nodes(edges: str, notes: str, assets: str) -> str:
    """The files, and of what edges point to the tags and phantoms, in the spelling of the tables."""
    return f"""{edges}, notes AS ({notes}), assets AS ({assets}),
spelled AS (SELECT nm AS name FROM nat UNION ALL SELECT nm || '.png' FROM nat UNION ALL SELECT 'Segment ' || seg FROM cus UNION ALL SELECT 'x.png')
SELECT 'note:path:' || path AS node_key, 'note' AS type, regexp_extract(path, '([^/]*)\\.md$', 1) AS name, path, true AS exists_flag FROM notes
UNION ALL SELECT 'asset:path:' || path, 'asset', regexp_extract(path, '([^/]*)$', 1), path, true FROM assets
UNION ALL SELECT DISTINCT dst_key, 'phantom', spelled.name, CAST(NULL AS VARCHAR), false FROM x JOIN spelled ON dst_key = 'phantom:name:' || lower(spelled.name)
UNION ALL SELECT DISTINCT dst_key, 'tag', substr(dst_key, 10), CAST(NULL AS VARCHAR), false FROM x WHERE dst_key LIKE 'tag:name:%'"""


_REGION, _SUPPLIER = "SELECT 'regions/R' || r_regionkey || '.md' AS path FROM region", "SELECT 'suppliers/s' || sk || '.md' FROM sup"
_CUSTOMER, _NATION = "SELECT 'customers/c' || ck || '.md' FROM cus", "SELECT 'nations/' || nm || '.md' FROM nat"
_NOTES = f"{_REGION} UNION ALL {_SUPPLIER} UNION ALL {_CUSTOMER}"
_PICTURES = "SELECT 'img/' || nm || '.png' AS path FROM nat WHERE k % 2 = 0"
_EXTRA = "SELECT 'extra/R' || r_regionkey || '.md' AS path FROM region UNION ALL SELECT DISTINCT 'extra/Segment ' || seg || '.md' FROM cus"
_ADDED = _sql_edges(r="'[[regions/R' || rk || ']]'", segment="'note:path:extra/Segment ' || seg || '.md'", more=f"UNION ALL SELECT 'note:path:' || path, 'note:path:nations/NATION_1.md', 'wikilink', '[[NATION_1]]', 1 FROM ({_EXTRA})")
_UPDATED = _sql_edges(
    suppliers="false", customers="ck % 2 = 1",
    more="""UNION ALL SELECT 'note:path:suppliers/s' || sk || '.md', 'note:path:regions/R0.md', 'wikilink', '[[R0]]', 1 FROM sup
UNION ALL SELECT 'note:path:suppliers/s' || sk || '.md', 'tag:name:' || t, 'tag', t, 1 FROM (SELECT sk, unnest(['#kind', '#kind/other']) t FROM sup)""",
)
_DELETED = _sql_edges(nations="false", nation="'phantom:name:' || lower(nm)")
_WENT = _sql_edges(folder="world/nations", pic="'[map](../../img/' || nm || '.png)'", back="'[nation](world/nations/' || nm || '.md#top)'", old="'note:path:world/nations/' || nm || '.md'")
_SHOWN = " SELECT src_key, dst_key, link_type, raw_link, line FROM x"
_PIC0 = "CASE WHEN k % 2 = 0 THEN {} ELSE {} END"
SQL = {
    "vault_build_nodes": _sql_nodes(_sql_edges(), f"{_NOTES} UNION ALL {_NATION}", _PICTURES),
    "vault_build_edges": _sql_edges() + _SHOWN,
    "vault_add_nodes": _sql_nodes(_ADDED, f"{_NOTES} UNION ALL {_NATION} UNION ALL {_EXTRA}", _PICTURES),
    "vault_add_edges": _ADDED + _SHOWN,
    "vault_add_texts": _sql_texts(r="'[[regions/R' || rk || ']]'", more=f"UNION ALL SELECT path, '[[NATION_1]]' || chr(10) FROM ({_EXTRA})"),
    "vault_update_nodes": _sql_nodes(_UPDATED, f"{_REGION} UNION ALL {_SUPPLIER} UNION ALL {_NATION} UNION ALL {_CUSTOMER} WHERE ck % 2 = 1", _PICTURES),
    "vault_update_edges": _UPDATED + _SHOWN,
    "vault_delete_nodes": _sql_nodes(_DELETED, _NOTES, "SELECT '' AS path WHERE false"),
    "vault_delete_edges": _DELETED + _SHOWN,
    "vault_move_nodes": _sql_nodes(_WENT, f"{_NOTES} UNION ALL SELECT 'world/nations/' || nm || '.md' FROM nat", _PICTURES),
    "vault_move_edges": _WENT + _SHOWN,
    "vault_move_texts": _sql_texts(folder="world/nations", pic="'[map](../../img/' || nm || '.png)'", back="'[nation](world/nations/' || nm || '.md#top)'"),
    "vault_repair_texts": _sql_texts(old=_NM, pic=_PIC0.format(_MAP, "'[map](' || nm || '.png)'")),
    "vault_simplify_texts": _sql_texts(home="'[[R' || rk || '|home]]'", pic=_PIC0.format("'[map](' || nm || '.png)'", _MAP), back="'[nation](' || nm || '.md#top)'"),
    "vault_convert_texts": _sql_texts(pic="'[[../img/' || nm || '.png|map]]'", back="'[[../nations/' || nm || '#top|nation]]'"),
    "vault_disambiguate_texts": _sql_texts(r="CASE WHEN rk = 0 THEN '[[regions/R0]]' ELSE '[[R' || rk || ']]' END"),
    "vault_query": f"""{_BASE}, b AS (SELECT 'suppliers/s' || sk || '.md' AS p FROM sup WHERE nm = 'NATION_0' UNION ALL SELECT 'customers/c' || ck || '.md' FROM cus WHERE nm = 'NATION_0'),
o AS (SELECT row_number() OVER (ORDER BY p) - 1 AS i, p FROM b)
SELECT 'entry' AS field, 0 AS pos, 'nations/NATION_0.md' AS value
UNION ALL SELECT 'backlinks', CAST(i AS INTEGER), p FROM o WHERE i < 100
UNION ALL SELECT 'outgoing', 0, 'img/NATION_0.png' UNION ALL SELECT 'outgoing', 1, 'regions/R' || rk || '.md' FROM nat WHERE k = 0
UNION ALL SELECT 'tags', 0, '#area/r' || rk FROM nat WHERE k = 0 UNION ALL SELECT 'tags', 1, '#nation'
UNION ALL SELECT 'head', 0, '[[R' || rk || ']] and [map](../img/NATION_0.png)' FROM nat WHERE k = 0""",
    "vault_cli": f"""{_sql_edges()}, c AS (SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nat) + (SELECT count(*) FROM sup) + (SELECT count(*) FROM cus) AS notes,
  (SELECT count(*) FROM x) AS edges, (SELECT count(DISTINCT dst_key) FROM x WHERE dst_key LIKE 'tag:%') AS tags, (SELECT count(DISTINCT dst_key) FROM x WHERE dst_key LIKE 'phantom:%') AS phantoms,
  (SELECT count(*) FROM nat WHERE k % 2 = 0) AS assets),
t AS (SELECT 'stats' AS command, ['notes_total: ' || notes, 'notes_exists: ' || notes, 'edges_total: ' || edges, 'tags_total: ' || tags, 'phantoms_total: ' || phantoms, 'assets_total: ' || assets] AS ls FROM c
UNION ALL SELECT 'stats of some', ['{{', '  "notes_total": ' || notes || ',', '  "assets_total": ' || assets, '}}'] FROM c
UNION ALL SELECT 'resolve', ['type: note', 'name: R0', 'path: regions/R0.md', 'exists: true']
UNION ALL SELECT 'resolve some', ['path: img/NATION_0.png', 'exists: true'] UNION ALL SELECT 'resolve phantom', ['{{', '  "type": "phantom",', '  "name": "NATION_1.png"', '}}']
UNION ALL SELECT 'query', ['entry:', '  type: note', '  name: NATION_0', '  path: nations/NATION_0.md', '  exists: true', 'outgoing:', '- type: asset', '  name: NATION_0.png', '  path: img/NATION_0.png', '  exists: true',
  '- type: note', '  name: R' || rk, '  path: regions/R' || rk || '.md', '  exists: true', 'tags:', '- #area/r' || rk, '- #nation', 'head:', '- "[[R' || rk || ']] and [map](../img/NATION_0.png)"'] FROM nat WHERE k = 0
UNION ALL SELECT 'diagnose', [''] UNION ALL SELECT 'convert', ['{{', '  "rewritten": []', '}}']
UNION ALL SELECT 'disambiguate', list_prepend('rewritten:', flatten(list(['- file: nations/' || nm || '.md', '  old: "[[R0]]"', '  new: "[[regions/R0]]"'] ORDER BY nm || '.md'))) FROM nat WHERE rk = 0)
SELECT command, CAST(unnest(generate_series(0, len(ls) - 1)) AS INTEGER) AS pos, unnest(ls) AS line FROM t""",
    "vault_resolve": """SELECT * FROM (VALUES ('nations/NATION_0.md', '[[R0]]', 'note', 'R0', 'regions/R0.md', ''), ('nations/NATION_0.md', '[map](../img/NATION_0.png)', 'asset', 'NATION_0.png', 'img/NATION_0.png', ''),
  ('nations/NATION_1.md', '[map](../img/NATION_1.png)', 'phantom', 'NATION_1.png', NULL, ''), ('suppliers/s0.md', '#kind/supplier', 'tag', '#kind/supplier', NULL, '')) t(source, link, type, name, path, subpath)""",
    "vault_errors": """SELECT * FROM (VALUES ('add known', 'file already registered: regions/R0.md'), ('add absent', 'file not found: zzz.md'), ('update unknown', 'file not registered: zzz.md'),
  ('delete present', 'file still exists on disk: regions/R0.md'), ('move to itself', 'source and destination are the same'), ('move out', 'path escapes vault: ../R0.md'),
  ('move to known', 'destination already registered: regions/R1.md'), ('move unknown', 'file not registered: zzz.md'), ('query file', 'file not found in index: zzz.md'), ('query tag', 'tag not found: zzz'),
  ('query two', 'exactly one of file, tag, phantom and name must be given'), ('resolve source', 'source not in index: zzz.md'), ('resolve link', 'link not found in source: [[NATION_1]] in nations/NATION_0.md'),
  ('disambiguate', 'no note found with basename: zzz'), ('convert', 'invalid format: ''html'' (must be wikilink or markdown)')) t(command, message)""",
}
