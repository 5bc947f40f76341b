"""Results as JSON and as text for the command line."""

from __future__ import annotations

import json

from linkloom.runtime import Rows

FORMATS = ("text", "json")
#: What is shown in quotes in text: links as they are written, and lines of notes.
_QUOTED = frozenset({"old", "new", "raw_link", "head", "content"})


def check_format(name: str) -> str:
    if name not in FORMATS:
        raise ValueError(f"invalid format: {name} (must be text or json)")
    return name


def parse_fields(text: str | None, known: list[str], command: str = "") -> list[str]:
    """The fields of a comma list, in order and once; none means all. An unknown field is an error."""
    out = list(dict.fromkeys(f.strip() for f in (text or "").split(",") if f.strip()))
    for f in out:
        if f not in known:
            raise ValueError(f"unknown {command} field: {f}".replace("  ", " "))
    return out


def shaped(x: object) -> object:
    """A result as it is shown: only files have a path and exist or not, and a snippet's lines are a range with their content."""
    if isinstance(x, (list, Rows)):
        return [shaped(y) for y in x]
    if not isinstance(x, dict):
        return x
    if "exists" in x and x.get("type", "note") not in ("note", "asset"):
        return {k: shaped(v) for k, v in x.items() if k not in ("path", "exists")}
    if "line_start" in x:
        return {"source": x["source"], "lines": f"{x['line_start']}-{x['line_end']}", "content": x["lines"]}
    return {("snippet" if k == "snippets" else k): shaped(v) for k, v in x.items()}


def as_json(result: dict, keep_empty: bool) -> str:
    """Queries leave out what is empty; reports of changes keep it."""
    shown = shaped(result)
    return json.dumps(shown if keep_empty else {k: v for k, v in shown.items() if v not in (None, [], {})}, indent=2, ensure_ascii=False)


def _one_line(node: dict) -> str:
    return f"{node['type']}: {node.get('path') or node['name']}"


def _value(key: str, x: object) -> str:
    return json.dumps(x, ensure_ascii=False) if key in _QUOTED else str(x).lower() if isinstance(x, bool) else str(x)


def _lines(result: dict) -> list[str]:
    """``key: value`` a line; what is below a key is indented or, in a list, led by a dash. Empty lists aren't shown."""
    out: list[str] = []
    for key, x in result.items():
        if key == "via":
            out.append(f"via: {_one_line(x)}")
        elif isinstance(x, dict):
            out += [f"{key}:", *(f"  {line}" for line in _lines(x))]
        elif isinstance(x, list):
            out += [f"{key}:"] * bool(x)
            for y in x:
                inner = [_one_line(y)] if key == "targets" else _lines(y) if isinstance(y, dict) else [_value(key, y)]
                out += [f"{'  ' if i else '- '}{line}" for i, line in enumerate(inner)]
        elif x is not None:
            out.append(f"{key}: {_value(key, x)}")
    return out


def as_text(result: dict) -> str:
    return "\n".join(_lines(shaped(result)))
