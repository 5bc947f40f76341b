"""A folder of notes with its index: every command of the command line as a method."""

from __future__ import annotations

import os
import posixpath
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.globs import Excludes
from linkloom.functions.paths import note_name_key
from linkloom.operators import graph as G
from linkloom.operators import query as Q
from linkloom.operators import rewrite as R
from linkloom.operators.extract import LINKS, occurrences
from linkloom.runtime import Rows, stage
from linkloom.sources import files as FS
from linkloom.sources.store import Store


class VaultError(ValueError):
    pass


def _clean(path: str) -> str:
    return posixpath.normpath(path.replace(os.sep, "/"))


class Vault:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, os.path.abspath(root)
        self.store = Store(spark, f"file://{self.root}/{FS.DATA_DIR}")

    # ---- files

    def _listed(self, assets: bool = True) -> tuple[DataFrame, DataFrame | None]:
        """(path) of the notes and of the assets that aren't excluded."""
        ex = FS.Config.load(self.root).build_excludes
        return FS.notes_in(self.spark, self.root, ex), FS.assets_in(self.spark, self.root, ex) if assets else None

    def _notes(self, paths: DataFrame) -> DataFrame:
        """The texts of notes (path), in no order."""
        return FS.read_notes(self.spark, self.root, paths.select("path", F.lit(0).cast("long").alias("walk_ord")))

    def _exists(self, path: str) -> bool:
        return os.path.exists(os.path.join(self.root, path))

    def _paths(self, paths: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(p,) for p in paths], "path string")

    @staticmethod
    def _files(plan: DataFrame) -> DataFrame:
        """(path) of the notes whose texts a plan changes."""
        return plan.select(F.col("file").alias("path")).distinct()

    @staticmethod
    def _report(plan: DataFrame, first: list[str] = ()) -> Rows:
        return Rows(plan, [*first, "file", "line", "occ_ord"], lambda r: {"file": r.file, "old": r.raw_link, "new": r.new_link})

    def _apply(self, plan: DataFrame, at: DataFrame | None = None) -> DataFrame | None:
        """Write what a staged plan changes; ``at`` (file, path) has where files lie that the plan has elsewhere. The old texts (path, content, raw), staged."""
        if plan.isEmpty():
            return None
        where = plan.select("file").distinct()
        where = where.withColumn("path", F.col("file")) if at is None else where.join(at, "file", "left").select("file", F.coalesce("path", "file").alias("path"))
        old = stage(self._notes(where).join(where, "path").select("path", "content", "raw", "file"), "old")
        texts = R.applied(old.select(F.col("file").alias("path"), "content"), plan)
        if at is not None:
            texts = texts.withColumnRenamed("path", "file").join(old.select("file", "path"), "file")
        FS.write_all(self.root, texts, old)
        return old

    def _restore(self, *old: DataFrame | None) -> None:
        for texts in old:
            if texts is not None:
                FS.restore(self.root, texts)

    def _publish(self, g: G.Graph, old: DataFrame | None) -> None:
        """The new snapshot; if that fails the texts go back to what they were."""
        try:
            self.store.publish(g)
        except Exception:
            self._restore(old)
            raise

    def _with_mtimes(self, g: G.Graph, paths: DataFrame) -> G.Graph:
        now = FS.mtimes(self.root, paths).select(F.concat(F.lit("note:path:"), "path").alias("node_key"), "now")
        nodes = g.nodes.join(now, "node_key", "left").withColumn("mtime", F.coalesce("now", "mtime")).select(G.NODE_COLUMNS)
        return G.Graph(nodes, g.edges)

    def _fresh(self, g: G.Graph, paths: DataFrame) -> None:
        known = g.nodes.filter("type = 'note'").select("path", "mtime")
        state = FS.mtimes(self.root, paths).join(known, "path", "left")
        for r in state.filter("now is null or mtime is null or now <> mtime").orderBy("path").limit(1).collect():
            raise VaultError(f"file not found: {r.path}" if r.now is None else f"source file is stale: {r.path}")

    # ---- build and change

    def build(self) -> G.Graph:
        notes, assets = self._listed()
        return self.store.publish(G.build(FS.read_notes(self.spark, self.root, FS.ranked(notes)), stage(FS.asset_files(self.root, FS.ranked(assets)), "assets")))

    def _next(self, g: G.Graph) -> int:
        top = g.nodes.filter("type = 'note'").agg(F.max("node_ord")).first()[0]
        return 0 if top is None else top + 1

    def add(self, paths: list[str], auto_disambiguate: bool = True) -> dict:
        g = self.store.read()
        paths = list(dict.fromkeys(_clean(p) for p in paths))
        known = {r.path for r in g.nodes.filter("type = 'note'").join(self._paths(paths), "path").select("path").collect()}
        for p in paths:
            if p in known:
                raise VaultError(f"file already registered: {p}")
            if not self._exists(p):
                raise VaultError(f"file not found: {p}")
        new = self._paths(paths)
        plan, unclear = R.add_plan(g, new)
        plan = stage(plan, "plan")
        if unclear.limit(1).collect() or (not auto_disambiguate and plan.limit(1).collect()):
            raise VaultError("adding files would make existing links ambiguous")
        self._fresh(g, self._files(plan))
        notes = FS.read_notes(self.spark, self.root, paths, self._next(g))
        universe = g.notes().unionByName(notes.select("path", "walk_ord"))
        after = G.refreshed(g, notes, universe)
        order = self.spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, ord long")
        after, gave = G.promoted(after, order)
        promoted = sorted(r.path for r in gave.collect())
        old = self._apply(plan)
        self._publish(G.without_orphans(self._with_mtimes(G.relinked(after, plan), self._files(plan))), old)
        return {"added": paths, "promoted": promoted, "rewritten": self._report(plan)}

    def update(self, paths: list[str] | DataFrame) -> dict:
        """Notes whose files have changed or are gone: a list, or (path, pos) with each path once, clean, in the order of ``pos``."""
        g = self.store.read()
        if not isinstance(paths, DataFrame):
            paths = self.spark.createDataFrame([(p, i) for i, p in enumerate(dict.fromkeys(_clean(p) for p in paths))], "path string, pos long")
        known = g.nodes.filter("type = 'note'").select("path", F.col("node_ord").alias("walk_ord"))
        asked = stage(paths.join(FS.mtimes(self.root, paths), "path").join(known, "path", "left"), "asked")
        for r in asked.filter("walk_ord is null").orderBy("pos").limit(1).collect():
            raise VaultError(f"file not registered: {r.path}")
        here, gone = asked.filter("now is not null"), asked.filter("now is null")
        if not here.isEmpty():
            g = G.refreshed(g, FS.read_notes(self.spark, self.root, here), g.notes().join(gone.select("path"), "path", "left_anti"))
        g, facts = G.removed(g, gone.select(F.concat(F.lit("note:path:"), "path").alias("node_key"), "pos"))
        facts = stage(facts, "facts")
        self.store.publish(G.without_orphans(g))
        of = lambda rows: Rows(rows, ["pos"], lambda r: r.path)
        return {"updated": of(here), "deleted": of(facts.filter("not phantomed")), "phantomed": of(facts.filter("phantomed"))}

    def _registered(self, g: G.Graph, paths: list[str], kinds: tuple[str, ...]) -> dict[str, str]:
        rows = g.nodes.filter(F.col("type").isin(*kinds)).join(self._paths(paths), "path").select("path", "node_key", "type").orderBy("type").collect()
        keys: dict[str, str] = {}
        for r in rows:  # of a note and an asset with one path the note counts
            keys[r.path] = r.node_key
        for p in paths:
            if p not in keys:
                raise VaultError(f"file not registered: {p}")
        return keys

    def listed(self, folder: str, kind: str) -> list[str]:
        """The registered files of a kind below a folder."""
        at = folder.rstrip("/") + "/"
        return [r.path for r in self.store.read().nodes.filter((F.col("type") == kind) & F.col("path").startswith(at)).orderBy("path").collect()]

    def delete(self, paths: list[str], remove_files: bool = False) -> dict:
        g = self.store.read()
        folders = [p for p in paths if os.path.isdir(os.path.join(self.root, p)) or p.endswith("/")]
        paths = [q for p in paths for q in ([*self.listed(p, "note"), *self.listed(p, "asset")] if p in folders else [p])]
        paths = list(dict.fromkeys(_clean(p) for p in paths))
        keys = self._registered(g, paths, ("note", "asset"))
        for p in paths:
            if p.startswith("../") or os.path.isabs(p):
                raise VaultError(f"path escapes vault: {p}")
            if not remove_files and self._exists(p):
                raise VaultError(f"file still exists on disk: {p}")
        g, facts = G.removed(g, self.spark.createDataFrame([(keys[p], i) for i, p in enumerate(paths)], "node_key string, pos long"))
        ended = facts.orderBy("pos").collect()
        self.store.publish(g)
        if remove_files:
            for p in paths:
                Path(self.root, p).unlink(missing_ok=True)
            for f in folders:
                left = FS.assets_below(self.root, f)
                for p in left:
                    Path(self.root, p).unlink(missing_ok=True)
                FS.remove_empty_folders(self.root, left)
            FS.remove_empty_folders(self.root, paths)
        return {"deleted": [r.path for r in ended if not r.phantomed], "phantomed": [r.path for r in ended if r.phantomed]}

    def move(self, src: str, dst: str) -> dict:
        """A file or a folder. The disk may have been changed already: then only the index and the links follow."""
        src, dst = _clean(src), _clean(dst)
        if src == dst:
            raise VaultError("source and destination are the same")
        if dst.startswith("../") or os.path.isabs(dst) or src.startswith("../") or os.path.isabs(src):
            raise VaultError(f"path escapes vault: {dst}")
        g = self.store.read()
        one = g.nodes.filter((F.col("path") == src) & F.col("type").isin("note", "asset")).orderBy(F.col("type").desc()).limit(1).collect()
        if one:
            return self._move(g, [(src, dst)], batch=False)
        if dst.startswith(src + "/") or src.startswith(dst + "/"):
            raise VaultError("source and destination overlap")
        inside = [*self.listed(src, "note"), *self.listed(src, "asset")]
        if not inside:
            raise VaultError(f"file not registered: {src}")
        pairs = [(p, dst + p[len(src) :]) for p in inside]
        known = set(inside)
        extra = [p for p in FS.assets_below(self.root, src) if p not in known]
        out = self._move(g, pairs, batch=True, extra=[(p, dst + p[len(src) :]) for p in extra])
        return out

    def _move(self, g: G.Graph, pairs: list[tuple[str, str]], batch: bool, extra: list[tuple[str, str]] = ()) -> dict:
        taken = g.nodes.filter("exists_flag").join(self._paths([b for _, b in pairs]), "path").select("path").collect()
        if taken:
            raise VaultError(f"destination already registered: {taken[0].path}")
        known = {r.path: r for r in g.nodes.filter("exists_flag").join(self._paths([a for a, _ in pairs]), "path").collect()}
        on_disk = {(self._exists(a), self._exists(b)) for a, b in pairs}
        if len(on_disk) > 1:
            raise VaultError("inconsistent disk state: some files have moved and some haven't")
        before, after_ = on_disk.pop()
        if before and after_:
            raise VaultError("both source and destination exist on disk")
        if not before and not after_:
            raise VaultError("neither source nor destination exists on disk")
        at = {a: (a if before else b) for a, b in pairs}
        for a, _ in pairs:
            if FS.mtime(self.root, at[a]) != known[a].mtime:
                raise VaultError(f"source file is stale: {a}")
        moved = self.spark.createDataFrame(pairs, "from_path string, to_path string")
        notes = [a for a, _ in pairs if known[a].type == "note"]
        text = FS.read_notes(self.spark, self.root, [at[a] for a in notes]).join(self.spark.createDataFrame([(a, at[a]) for a in notes], "file string, path string"), "path").select(F.col("file").alias("path"), "content", "walk_ord")
        outside = stage(R.move_plan(g, moved), "plan")
        inside = stage(R.moved_outgoing_plan(g, occurrences(text), moved, batch), "plan")
        old = self._apply(outside)
        try:
            own = self._apply(inside, self.spark.createDataFrame(list(at.items()), "file string, path string"))
        except Exception:
            self._restore(old)
            raise
        renamed: list[tuple[str, str]] = []
        try:
            if before:
                for a, b in [*pairs, *extra]:
                    os.makedirs(os.path.dirname(os.path.join(self.root, b)) or self.root, exist_ok=True)
                    os.rename(os.path.join(self.root, a), os.path.join(self.root, b))
                    renamed.append((a, b))
            g = G.renamed(G.relinked(g, outside), moved)
            ords = {b: known[a].node_ord for a, b in pairs if known[a].type == "note"}
            if ords:
                fresh = FS.read_notes(self.spark, self.root, list(ords)).drop("walk_ord").join(self.spark.createDataFrame(list(ords.items()), "path string, walk_ord long"), "path")
                g = G.refreshed(g, fresh, g.notes(), check=False)
            for kind in ("note", "asset"):
                went = [(b, i) for i, (a, b) in enumerate(pairs) if known[a].type == kind]
                if went:
                    g, _ = G.promoted(g, self.spark.createDataFrame(went, "path string, ord long"), kind == "asset")
            self.store.publish(G.without_orphans(self._with_mtimes(g, self._files(outside))))
        except Exception:
            for a, b in reversed(renamed):
                os.rename(os.path.join(self.root, b), os.path.join(self.root, a))
            self._restore(old, own)
            raise
        FS.remove_empty_folders(self.root, [a for a, _ in pairs])
        out = {"rewritten": self._report(outside.withColumn("own", F.lit(False)).unionByName(inside.withColumn("own", F.lit(True))), ["own"])}
        return {"moved": [{"from": a, "to": b} for a, b in pairs], **out} if batch else {"from": pairs[0][0], "to": pairs[0][1], **out}

    # ---- rewrites of texts

    def _scope(self, notes: DataFrame, paths: list[str]) -> DataFrame | None:
        paths = [_clean(p) for p in paths]
        if not paths:
            return None
        known = {r.path for r in notes.join(self._paths(paths), "path", "left_semi").collect()}
        for p in paths:
            if p not in known:
                raise VaultError(f"file not found or excluded: {p}")
        return self._paths(paths)

    @staticmethod
    def _frame(paths: DataFrame) -> DataFrame:
        """Files as plans want them that have no walk: of those that share a name or path in another case the last by its path counts."""
        return paths.select("path", F.lit(0).cast("long").alias("walk_ord"))

    def _finish(self, plan: DataFrame, dry_run: bool) -> Rows:
        plan = stage(plan.select(R.PLAN), "plan")
        if not dry_run:
            self._apply(plan)
        return self._report(plan)

    @staticmethod
    def _skipped(rows: DataFrame) -> Rows:
        return Rows(stage(rows, "skipped"), ["file", "raw_link"], lambda r: r.asDict())

    def convert(self, to: str, paths: list[str] = (), dry_run: bool = False) -> dict:
        names, _ = self._listed(assets=False)
        occ = occurrences(self._notes(names), for_conversion=to == "wikilink", kinds=LINKS)
        plan = R.convert_plan(occ, self._frame(names), to, self._scope(names, list(paths)))
        return {"rewritten": self._finish(plan, dry_run)}

    def simplify(self, paths: list[str] = (), dry_run: bool = False) -> dict:
        names, others = self._listed()
        plan, skipped = R.simplify_plan(occurrences(self._notes(names), kinds=LINKS), self._frame(names), self._frame(others), self._scope(names, list(paths)))
        skipped = self._skipped(skipped)
        return {"rewritten": self._finish(plan, dry_run), "skipped": skipped}

    def repair(self, dry_run: bool = False) -> dict:
        names, _ = self._listed(assets=False)
        plan, skipped = R.repair_plan(occurrences(self._notes(names), kinds=LINKS), self._frame(names), FS.everything(self.spark, self.root))
        skipped = self._skipped(skipped)
        return {"rewritten": self._finish(plan, dry_run), "skipped": skipped}

    def disambiguate(self, name: str, target: str | None = None, paths: list[str] = (), scan: bool = False) -> dict:
        key = name.lower().removesuffix(".md")
        if scan:
            names, _ = self._listed(assets=False)
            cands = [r.path for r in names.filter(note_name_key(F.col("path")) == key).orderBy("path").collect()]
            to = R.disambiguate_target(cands, name, target and _clean(target))
            return {"rewritten": self._finish(R.disambiguate_scan_plan(occurrences(self._notes(names), kinds=LINKS), self._frame(names), key, to, self._scope(names, list(paths))), False)}
        g = self.store.read()
        cands = [r.path for r in g.notes().filter(note_name_key(F.col("path")) == key).orderBy("path").collect()]
        to = R.disambiguate_target(cands, name, target and _clean(target))
        paths = [_clean(p) for p in paths]
        if paths:
            self._registered(g, paths, ("note",))
        plan = stage(R.disambiguate_plan(g, key, to, self._paths(paths) if paths else None), "plan")
        self._fresh(g, self._files(plan))
        old = self._apply(plan)
        if old is not None:
            self._publish(self._with_mtimes(G.relinked(g, plan), self._files(plan)), old)
        return {"rewritten": self._report(plan)}

    # ---- queries

    def excludes(self, paths: list[str] = (), tags: list[str] = (), none: bool = False) -> Excludes:
        c = FS.Config.load(self.root)
        return Excludes.merged([] if none else c.exclude_paths, [] if none else c.exclude_tags, list(paths), list(tags))

    def query(self, entry: Q.Entry, fields: list[str] = (), head: int = 0, snippet: int = 0, backlinks: int = 0, vias: int = 0, per_via: int = 0, ex: Excludes | None = None) -> dict:
        """The neighbourhood of one node; only the fields asked for are computed, all if none is named."""
        g, ex = self.store.read(), ex or self.excludes()
        row = Q.find_entry(g, entry)
        key = row.node_key
        shown = lambda r: {"type": r.type, "name": r.name, "path": r.path, "exists": r.exists_flag}
        want = lambda f: not fields or f in fields
        out: dict = {"entry": shown(row)}
        if want("backlinks"):
            out["backlinks"] = [shown(r) for r in Q.backlinks(g, key, backlinks, ex).collect()]
        if want("outgoing") and row.type == "note":
            out["outgoing"] = [shown(r) for r in Q.outgoing(g, key, ex).collect()]
        if want("tags") and row.type == "note":
            got = Q.note_tags(g, ex, key).collect()
            out["tags"] = got[0].tags if got else []
        if want("twohop"):
            rows = Q.two_hop(g, key, vias, per_via, ex).orderBy("via_pos", "pos").collect()
            via = {r.node_key: r for r in g.nodes.join(self.spark.createDataFrame([(r.via_key,) for r in rows] or [(key,)], "node_key string").distinct(), "node_key").collect()}
            out["twohop"] = [
                {"via": shown(via[k]), "targets": [{"type": r.target_type, "name": r.target_name, "path": r.target_path, "exists": r.target_exists_flag} for r in rows if r.via_key == k]}
                for k in dict.fromkeys(r.via_key for r in rows)
            ]
        if want("head") and head > 0 and row.type == "note" and row.exists_flag:
            self._current(g, [row.path])
            out["head"] = [r.line for r in Q.heads(FS.read_notes(self.spark, self.root, [row.path]), head).orderBy("pos").collect()]
        if want("snippet") and snippet > 0:
            src = g.nodes.filter("exists_flag and type = 'note'").filter(ex.keeps_path(F.col("path"))).select(F.col("node_key").alias("src_key"), F.col("path").alias("source"))
            rows = g.edges.filter(F.col("dst_key") == key).join(src, "src_key")
            names = [r.source for r in rows.select("source").distinct().orderBy("source").collect()]
            self._current(g, names)
            made = Q.snippets(rows, FS.read_notes(self.spark, self.root, names), snippet).orderBy("source", "line_start", "occ_ord").collect() if names else []
            out["snippets"] = [{"source": r.source, "line_start": r.line_start, "line_end": r.line_end, "lines": r.lines} for r in made]
        return out

    def _current(self, g: G.Graph, paths: list[str]) -> None:
        known = {r.path: r.mtime for r in g.nodes.filter("type = 'note'").join(self._paths(paths), "path").select("path", "mtime").collect()} if paths else {}
        for p in paths:
            if not self._exists(p):
                raise VaultError(f"file not found: {p}")
            if FS.mtime(self.root, p) != known[p]:
                raise VaultError(f"index is stale: {p}")

    def resolve(self, source: str, link: str) -> dict:
        r = Q.resolve_link(self.store.read(), _clean(source), link)
        return {"type": r.type, "name": r.name, "path": r.path, "exists": r.exists_flag, "subpath": r.subpath}

    def stats(self) -> dict:
        return Q.stats(self.store.read()).first().asDict()

    def diagnose(self) -> dict:
        g = self.store.read()
        show = lambda kind: [r.asDict() for r in Q.conflicts(g, kind).collect()]
        return {"basename_conflicts": show("note"), "asset_basename_conflicts": show("asset"), "phantoms": [r.name for r in Q.phantoms(g).collect()]}

