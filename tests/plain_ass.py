"""The lines of an ASS file read one by one in plain Python, for comparison."""

import re

from cueflow.functions.text import WS

_EDGES = re.compile(rf"\A{WS}+|{WS}+\Z")
#: Section headers by what their lines are read as; others are passed over.
_KINDS = {"script info": "info", "v4+ styles": "style", "v4 styles": "style", "events": "event"}
_ROW = {"style": "style", "event": "dialogue"}
_SPECIAL = ("start", "end", "text", "style")


def _trim(s: str) -> str:
    return _EDGES.sub("", s)


def _pairs(entries: dict[str, str]) -> list[dict]:
    return [{"k": k, "v": v} for k, v in entries.items()]


def _named(names: list[str], row: str) -> list[tuple[str, str]]:
    """The row's values under their names; the last one keeps its commas, missing ones are empty."""
    parts = row.split(",", len(names) - 1)
    return list(zip(names, [_trim(p) for p in parts] + [""] * (len(names) - len(parts)), strict=True))


def read_sections(text: str) -> dict:
    """title, info, styles and events of a text with LF line ends. Of keys given twice the last value counts, at the first one's place."""
    kind, title, info, styles, events = None, None, {}, [], []
    columns: dict[str, list[str]] = {"style": [], "event": []}
    for line in map(_trim, text.split("\n")):
        if not line or line.startswith(";"):
            continue
        if line.startswith("[") and line.endswith("]"):
            kind = _KINDS.get(_trim(line[1:-1]).lower())
            continue
        head, colon, value = line.partition(":")
        key = _trim(head)
        if kind is None or not colon or not key:
            continue
        if kind == "info":
            info[key] = _trim(value)
            title = info[key] if key.lower() == "title" else title
        elif key.lower() == "format":
            columns[kind] = [n for n in map(_trim, value.split(",")) if n]
        elif key.lower() == _ROW[kind] and columns[kind]:
            cells = _named(columns[kind], value)
            lower = {k.lower(): v for k, v in reversed(cells)}  # of names that differ in case only the first
            if kind == "style":
                styles.append({"name": lower.get("name", ""), "fields": _pairs(dict(cells))})
            elif all(c in lower for c in ("start", "end", "text")):
                rest = _pairs({k: v for k, v in cells if k.lower() not in _SPECIAL})
                events.append({c: lower.get(c) for c in _SPECIAL} | {"style": lower.get("style") or None, "rest": rest})
    return {"title": title, "info": _pairs(info), "styles": styles, "events": events}
