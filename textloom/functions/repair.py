"""JSON from model answers: the outermost container, with small repairs. Helpers inside tasks."""

from __future__ import annotations

import json
import re


def balanced(text: str) -> str | None:
    """The first balanced object or array, strings honoured; up to the end if it never closes."""
    begin = next((i for i, c in enumerate(text) if c in "{["), None)
    if begin is None:
        return None
    depth, quoted, escaped = 0, False, False
    for i in range(begin, len(text)):
        c = text[i]
        if quoted:
            escaped, quoted = (not escaped and c == "\\"), not (c == '"' and not escaped)
        elif c == '"':
            quoted = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if not depth:
                return text[begin : i + 1]
    return text[begin:]


def closed(text: str) -> str:
    """Trailing commas dropped, open strings and containers closed."""
    stack, quoted, escaped = [], False, False
    for c in text:
        if quoted:
            escaped, quoted = (not escaped and c == "\\"), not (c == '"' and not escaped)
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
    whole = text + '"' * quoted
    whole = re.sub(r",\s*$", "", whole) + "".join(reversed(stack))
    return re.sub(r",\s*([}\]])", r"\1", whole)


def repaired(text: str | None) -> str | None:
    """Compact JSON of the container in a text; null if there is none that can be read."""
    part = balanced(text or "")
    for attempt in (part, closed(part) if part else None):
        if attempt:
            try:
                return json.dumps(json.loads(attempt), ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                continue
    return None


def leaves(text: str | None) -> list[tuple[str, str]]:
    """(path, string) of all strings in a JSON text, in order."""
    try:
        root = json.loads(text or "")
    except ValueError:
        return []
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, object]] = [("$", root)]
    while stack:
        path, node = stack.pop()
        if isinstance(node, str):
            out.append((path, node))
        elif isinstance(node, list):
            stack += [(f"{path}[{i}]", x) for i, x in reversed(list(enumerate(node)))]
        elif isinstance(node, dict):
            key = lambda k: f".{k}" if re.fullmatch(r"[A-Za-z_$][\w$]*", k) else "['" + k.replace("'", "\\'") + "']"
            stack += [(path + key(k), v) for k, v in reversed(node.items())]
    return out


def with_path(text: str, path: str, value: str) -> str:
    """The JSON text with the string at a path replaced."""
    root = json.loads(text)
    keys = [a or (b.replace("\\'", "'") if b else int(c)) for a, b, c in re.findall(r"\.([A-Za-z_$][\w$]*)|\['((?:[^'\\]|\\.)*)'\]|\[(\d+)\]", path)]
    node = root
    for k in keys[:-1]:
        node = node[k]
    if keys:
        node[keys[-1]] = value
    return json.dumps(root, ensure_ascii=False, separators=(",", ":"))
