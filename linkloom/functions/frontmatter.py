"""Tags from the YAML block at the head of a note."""

from __future__ import annotations


def _values(block: str) -> list[tuple[str, int, bool]]:
    """(value, line, is a scalar) of what the top-level key ``tags`` holds. PyYAML must be there: another reader would read other tags."""
    import yaml

    try:
        root = yaml.compose(block, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    except (yaml.YAMLError, ValueError):
        return []
    if not isinstance(root, yaml.MappingNode):
        return []
    out: list[tuple[str, int, bool]] = []
    for key, value in root.value:
        if getattr(key, "value", None) != "tags":
            continue
        if isinstance(value, yaml.SequenceNode):
            out += [(x.value, x.start_mark.line, False) for x in value.value if isinstance(x, yaml.ScalarNode)]
        elif isinstance(value, yaml.ScalarNode):
            out.append((value.value, value.start_mark.line, True))
    return out


def frontmatter_tags(block: str) -> list[tuple[str, int]]:
    """(tag with ``#``, line in the note) of a YAML block that begins on the note's second line, ancestors before each tag.

    Only a top-level key ``tags`` counts, as a list or as one text with commas. Broken YAML gives nothing. Unlike in
    inline tags, empty parts of a nested tag are kept.
    """
    out: list[tuple[str, int]] = []
    for value, line, scalar in _values(block):
        for tag in [t.strip() for t in value.split(",")] if scalar else [value]:
            if tag:
                parts = tag.removeprefix("#").split("/")
                out += [("#" + "/".join(parts[: i + 1]), line + 2) for i in range(len(parts))]
    return out
