"""Places of JSON values in a text: a tolerant scan that keeps the text as written.

Used where a body must be changed byte for byte, and for bodies that VARIANT
does not hold (repeated keys) or that nest deeper than a plan has levels.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

_TOKEN = re.compile(r'[ \t\r\n]*(?:(?P<s>"(?:[^"\\\x00-\x1f]|\\.)*")|(?P<n>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<w>true|false|null)|(?P<p>[\[\]{},:]))')
_PLAIN_KEY = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


@dataclass(slots=True)
class Node:
    path: str
    parent_type: str
    type: str
    start: int
    member: int  # start of the key, or of the value where there is none
    end: int = 0
    last: int = 0  # index of the last node inside, itself included
    shadowed: bool = False  # a later member of the object has the same key


@dataclass(slots=True)
class _Open:
    node: int
    type: str
    count: int = 0
    key: str = ""
    member: int = 0
    keys: dict[str, int] = field(default_factory=dict)


def key_step(key: str) -> str:
    """``.key``, quoted unless it is a plain name, so that a dotted key is one step."""
    return "." + (key if _PLAIN_KEY.fullmatch(key) else '"' + key.replace("\\", "\\\\").replace('"', '\\"') + '"')


def scan(text: str) -> list[Node] | None:
    """All values in document order; None when the text is not one JSON value."""
    nodes: list[Node] = []
    open_: list[_Open] = []
    pos, want = 0, "value"
    while want != "end":
        m = _TOKEN.match(text, pos)
        if m is None:
            return None
        kind, pos = m.lastgroup, m.end()
        tok, at = m.group(kind), m.start(kind)
        top = open_[-1] if open_ else None
        closes = top is not None and tok == ("}" if top.type == "object" else "]") and want in ("first", "next")
        if closes:
            done = nodes[top.node]
            done.end, done.last = pos, len(nodes) - 1
            open_.pop()
            want = "next" if open_ else "end"
        elif want == "next":
            if tok != ",":
                return None
            want = "key" if top.type == "object" else "value"
        elif want == "key" or (want == "first" and top.type == "object"):
            colon = _TOKEN.match(text, pos)
            if kind != "s" or colon is None or colon.group(colon.lastgroup) != ":":
                return None
            top.key, top.member, pos, want = json.loads(tok), at, colon.end(), "value"
        else:
            if kind == "p" and tok not in "[{":
                return None
            path, parent, member = "$", "root", at
            if top is not None:
                parent = top.type
                if parent == "object":
                    path, member = nodes[top.node].path + key_step(top.key), top.member
                    if top.key in top.keys:
                        nodes[top.keys[top.key]].shadowed = True
                    top.keys[top.key] = len(nodes)
                else:
                    path = f"{nodes[top.node].path}[{top.count}]"
                    top.count += 1
            type_ = {"{": "object", "[": "array", "true": "boolean", "false": "boolean", "null": "null"}.get(tok) if kind in "pw" else ("string" if kind == "s" else "number")
            nodes.append(Node(path, parent, type_, at, member, pos, len(nodes)))
            if kind == "p":
                open_.append(_Open(len(nodes) - 1, type_))
                want = "first"
            else:
                want = "next" if open_ else "end"
    return nodes if not text[pos:].strip(" \t\r\n") else None


def live(text: str) -> list[tuple[str, str, str, str | None]]:
    """(path, parent_type, type, value) of every value a reader sees: of repeated keys the last counts."""
    nodes, out, i = scan(text) or [], [], 0
    repeats = any(n.shadowed for n in nodes)
    while i < len(nodes):
        n = nodes[i]
        if n.shadowed:
            i = n.last + 1
            continue
        raw = text[n.start : n.end]
        if repeats and n.type in ("object", "array"):
            raw = splice(raw, {})
        out.append((n.path, n.parent_type, n.type, None if n.type == "null" else json.loads(raw) if n.type == "string" else raw))
        i += 1
    return out


def splice(text: str, updates: dict[str, str]) -> str:
    """``text`` with the values at the given paths replaced by strings.

    All else stays byte for byte, except that shadowed members of repeated
    keys go: no reader sees them, and no rule has looked at them.
    """
    nodes = scan(text)
    if not nodes:
        return text
    out, done, i = [], 0, 0
    while i < len(nodes):
        n = nodes[i]
        if n.shadowed:  # up to the next member, which the later key guarantees
            out.append(text[done : n.member])
            i = n.last + 1
            done = nodes[i].member
        elif n.path in updates:
            out += [text[done : n.start], json.dumps(updates[n.path], ensure_ascii=False)]
            done, i = n.end, n.last + 1
        else:
            i += 1
    return "".join(out) + text[done:]
