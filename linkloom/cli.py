"""The command line: ``python -m linkloom.cli <command> --vault DIR``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from linkloom.operators.graph import LinkError
from linkloom.operators.query import Entry, QueryError
from linkloom.sources import render
from linkloom.sources.vault import Vault, VaultError

FIELDS = {
    "query": ["backlinks", "outgoing", "tags", "twohop", "head", "snippet"],
    "resolve": ["type", "name", "path", "exists", "subpath"],
    "stats": ["notes_total", "notes_exists", "edges_total", "tags_total", "phantoms_total", "assets_total"],
    "diagnose": ["basename_conflicts", "asset_basename_conflicts", "phantoms"],
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="linkloom")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, files: bool = False, dry: bool = False) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.add_argument("--vault", default=".")
        p.add_argument("--format", default="text")
        if name in FIELDS:
            p.add_argument("--fields")
        if files:
            p.add_argument("--file", action="append", default=[])
        if dry:
            p.add_argument("--dry-run", action="store_true")
        return p

    command("build")
    command("add", True).add_argument("--no-auto-disambiguate", action="store_true")
    command("update", True)
    command("delete", True).add_argument("--rm", action="store_true")
    p = command("move")
    p.add_argument("--from", dest="src", required=True)
    p.add_argument("--to", dest="dst", required=True)
    p = command("disambiguate", True)
    p.add_argument("--name", required=True)
    p.add_argument("--target")
    p.add_argument("--scan", action="store_true")
    command("simplify", True, True)
    command("repair", dry=True)
    command("convert", True, True).add_argument("--to", required=True)
    p = command("resolve")
    p.add_argument("--from", dest="src", required=True)
    p.add_argument("--link", required=True)
    p = command("query")
    for kind in ("file", "tag", "phantom", "name"):
        p.add_argument(f"--{kind}")
    for n in ("include-head", "include-snippet", "max-backlinks", "max-twohop", "max-via-per-target"):
        p.add_argument(f"--{n}", type=int, default=0)
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--exclude-tag", action="append", default=[])
    p.add_argument("--no-exclude", action="store_true")
    command("stats")
    command("diagnose")
    return top


def run(spark: SparkSession, args: list[str]) -> str:
    a = parser().parse_args(args)
    form = render.check_format(a.format)
    fields = render.parse_fields(getattr(a, "fields", None), FIELDS.get(a.command, []), a.command)
    v, name = Vault(spark, a.vault), a.command
    pick = lambda d: {k: d[k] for k in FIELDS[name] if k in d and (not fields or k in fields)}
    if name == "build":
        v.build()
        return ""
    if name == "query":
        q = v.query(Entry(a.file, a.tag, a.phantom, a.name), fields, a.include_head, a.include_snippet, a.max_backlinks, a.max_twohop, a.max_via_per_target, v.excludes(a.exclude, a.exclude_tag, a.no_exclude))
        return render.as_json(q, False) if form == "json" else render.as_text(q)
    result = {
        "add": lambda: v.add(a.file, not a.no_auto_disambiguate),
        "update": lambda: v.update(a.file),
        "delete": lambda: v.delete(a.file, a.rm),
        "move": lambda: v.move(a.src, a.dst),
        "disambiguate": lambda: v.disambiguate(a.name, a.target, a.file, a.scan),
        "simplify": lambda: v.simplify(a.file, a.dry_run),
        "repair": lambda: v.repair(a.dry_run),
        "convert": lambda: v.convert(a.to, a.file, a.dry_run),
        "resolve": lambda: pick({k: x for k, x in render.shaped(v.resolve(a.src, a.link)).items() if x != ""}),
        "stats": lambda: pick(v.stats()),
        "diagnose": lambda: pick(v.diagnose()),
    }[name]()
    return render.as_json(result, True) if form == "json" else render.as_text(result)


def main() -> int:
    spark = SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        out = run(spark, sys.argv[1:])
    except (LinkError, QueryError, VaultError, ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if out:
        print(out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
