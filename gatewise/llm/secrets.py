"""Secret scan: all rules in one byte pass of one deterministic automaton.

Each rule's regular expression is parsed into an NFA; the union of all rules,
each allowed to start anywhere, becomes a DFA by subset construction and is
minimised by partition refinement.  Bytes are mapped to classes, and the
transitions to one flat array, so a text is scanned with one look-up per byte
whatever the number of rules.  Where the automaton accepts, the span is
settled by two small automata of that rule: its reverse finds the leftmost
start, itself the longest end.  Matches of a rule do not overlap; a rule's
least lengths are applied afterwards, so a match that fails them is consumed.

Offsets are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewise.llm.batches import bound_batches


@dataclass(frozen=True)
class SecretRule:
    """``trigger`` is what the combined automaton looks for, a beginning of ``pattern``
    (counted repetitions that may restart inside themselves would blow the automaton
    up); ``pattern``, from the trigger's start, gives the span.  ``least`` characters
    are asked of the whole match, ``least_value`` of the value behind the separator."""

    kind: str
    pattern: str
    trigger: str | None = None
    least: int = 0
    least_value: int = 0


# The base rules and their least lengths, in order.
BASE_RULES = (
    SecretRule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", trigger=r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]""", least_value=6),
    SecretRule("access", r"AKIA[A-Z0-9]+", trigger=r"AKIA[A-Z0-9]", least=20),
    SecretRule("hex", r"[0-9a-f]+", trigger=r"[0-9a-f]{24}", least=24),
)
# Public token formats that the method adds.
ADDED_RULES = (
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36}[A-Za-z0-9]*", trigger=r"gh[pousr]_"),
    SecretRule("google", r"AIza[A-Za-z0-9_-]{35}", trigger=r"AIza"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8}[A-Za-z0-9_-]*\.eyJ[A-Za-z0-9_-]{8}[A-Za-z0-9_-]*\.[A-Za-z0-9_-]{8}[A-Za-z0-9_-]*", trigger=r"eyJ"),
    SecretRule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", trigger=r"-----BEGIN "),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10}[A-Za-z0-9-]*", trigger=r"xox[abprs]-"),
    SecretRule("stripe", r"[sr]k_live_[A-Za-z0-9]{24}[A-Za-z0-9]*", trigger=r"[sr]k_live_"),
)


# ---- regular expression -> NFA -------------------------------------------------


class _Nfa:
    """States with byte-set edges and empty edges; fragments are (start, end) pairs."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.edges: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.edges.append([])
        return len(self.empty) - 1

    def chars(self, allowed: frozenset[int]) -> tuple[int, int]:
        a, b = self.state(), self.state()
        self.edges[a].append((allowed, b))
        return a, b


class _Parser:
    """Literals, escapes, classes, (groups), (?i:groups), |, ?, *, +, {m}, {m,n}."""

    def __init__(self, pattern: str, backwards: bool = False):
        self.p, self.at, self.fold, self.backwards = pattern, 0, False, backwards
        self.nfa = _Nfa()

    def peek(self) -> str:
        return self.p[self.at] if self.at < len(self.p) else ""

    def take(self) -> str:
        self.at += 1
        return self.p[self.at - 1]

    def parse(self) -> tuple:
        tree = self.either()
        if self.at != len(self.p):
            raise ValueError(f"unexpected {self.peek()!r} in {self.p!r}")
        return tree

    def either(self) -> tuple:
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return ("or", options)

    def sequence(self) -> tuple:
        items = []
        while self.peek() not in ("", "|", ")"):
            items.append(self.repeated())
        return ("seq", items)

    def repeated(self) -> tuple:
        item = self.atom()
        while self.peek() and self.peek() in "?*+{":
            sign = self.take()
            if sign == "{":
                end = self.p.index("}", self.at)
                low, _, high = self.p[self.at : end].partition(",")
                bounds = (int(low), int(high) if high else (None if "," in self.p[self.at : end] else int(low)))
                self.at = end + 1
            else:
                bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}[sign]
            item = ("rep", item, *bounds)
        return item

    def atom(self) -> tuple:
        c = self.take()
        if c == "(":
            before = self.fold
            if self.p.startswith("?i:", self.at):
                self.fold, self.at = True, self.at + 3
            elif self.p.startswith("?:", self.at):
                self.at += 2
            tree = self.either()
            if self.take() != ")":
                raise ValueError(f"unclosed group in {self.p!r}")
            self.fold = before
            return tree
        if c == "[":
            return ("set", self.char_class())
        if c == "\\":
            return ("set", self.folded({self.escape()}))
        if c == ".":
            return ("set", frozenset(range(256)) - {10})
        return ("set", self.folded({ord(c)}))

    def escape(self) -> int:
        c = self.take()
        if c == "x":
            self.at += 2
            return int(self.p[self.at - 2 : self.at], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def char_class(self) -> frozenset[int]:
        negate = self.peek() == "^"
        if negate:
            self.take()
        out: set[int] = set()
        while (c := self.take()) != "]":
            low = self.escape() if c == "\\" else ord(c)
            if self.peek() == "-" and self.p[self.at + 1] != "]":
                self.take()
                c = self.take()
                high = self.escape() if c == "\\" else ord(c)
                out.update(range(low, high + 1))
            else:
                out.add(low)
        return frozenset(range(256)) - out if negate else self.folded(out)

    def folded(self, chars: set[int]) -> frozenset[int]:
        if self.fold:
            chars = chars | {c ^ 32 for c in chars if chr(c).isascii() and chr(c).isalpha()}
        return frozenset(chars)


def _build(nfa: _Nfa, tree: tuple, backwards: bool) -> tuple[int, int]:
    if tree[0] == "set":
        return nfa.chars(tree[1])
    a, b = nfa.state(), nfa.state()
    if tree[0] == "or":
        for option in tree[1]:
            s, e = _build(nfa, option, backwards)
            nfa.empty[a].append(s)
            nfa.empty[e].append(b)
        return a, b
    if tree[0] == "seq":
        at = a
        for item in reversed(tree[1]) if backwards else tree[1]:
            s, e = _build(nfa, item, backwards)
            nfa.empty[at].append(s)
            at = e
        nfa.empty[at].append(b)
        return a, b
    _, item, low, high = tree
    at = a
    for _ in range(low):
        s, e = _build(nfa, item, backwards)
        nfa.empty[at].append(s)
        at = e
    if high is None:
        s, e = _build(nfa, item, backwards)
        nfa.empty[at] += [s, b]
        nfa.empty[e] += [s, b]
    else:
        for _ in range(high - low):
            s, e = _build(nfa, item, backwards)
            nfa.empty[at] += [s, b]
            at = e
        nfa.empty[at].append(b)
    return a, b


# ---- NFA -> minimal DFA ----------------------------------------------------------


@dataclass
class Dfa:
    """``classes`` maps a byte to its class; ``table[state * width + class]`` is the next
    state times ``width``.  State 0 is the start; ``accepts`` lists the rules of a state."""

    classes: bytes
    width: int
    table: list[int]
    accepts: list[tuple[int, ...]]
    dead: int | None

    @property
    def states(self) -> int:
        return len(self.accepts)


def compile_dfa(patterns: list[str], anywhere: bool, backwards: bool = False) -> Dfa:
    """Minimal DFA of the union; ``anywhere`` lets every rule start at any byte."""
    nfa, starts, finals = _Nfa(), [], {}
    for rule, pattern in enumerate(patterns):
        s, e = _build(nfa, _Parser(pattern).parse(), backwards)
        starts.append(s)
        finals[e] = rule

    def closure(states: set[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(s for s in seen if nfa.edges[s] or s in finals)

    marks = np.zeros(256, dtype=object)
    distinct = {allowed for edges in nfa.edges for allowed, _ in edges}
    for bit, allowed in enumerate(distinct):
        for c in allowed:
            marks[c] = int(marks[c]) | (1 << bit)
    kinds = {m: i for i, m in enumerate(dict.fromkeys(int(m) for m in marks))}
    classes = bytes(kinds[int(m)] for m in marks)
    width = len(kinds)
    sample = [classes.index(k) for k in range(width)]

    first = closure(set(starts))
    index, rows, todo = {first: 0}, [], [first]
    for subset in todo:
        row = []
        for c in sample:
            after = closure({t for s in subset for allowed, t in nfa.edges[s] if c in allowed})
            if anywhere:
                after |= first
            if after not in index:
                index[after] = len(todo)
                todo.append(after)
            row.append(index[after])
        rows.append(row)
    accepts = [tuple(sorted(finals[s] for s in subset if s in finals)) for subset in todo]

    # partition refinement: states stay together while they accept the same rules and
    # go to the same groups
    table = np.array(rows, dtype=np.int64)
    group = np.unique(np.array([hash(a) for a in accepts], dtype=np.int64), return_inverse=True)[1]
    while True:
        key = np.column_stack([group, group[table]])
        after = np.unique(key, axis=0, return_inverse=True)[1].reshape(-1)
        if after.max() == group.max():
            break
        group = after
    order = list(dict.fromkeys(group.tolist()))  # the start's group first
    number = {g: i for i, g in enumerate(order)}
    member = [int(np.flatnonzero(group == g)[0]) for g in order]
    small = [[number[int(group[t])] for t in rows[m]] for m in member]
    dead = next((i for i, row in enumerate(small) if not accepts[member[i]] and all(t == i for t in row)), None)
    return Dfa(classes, width, [t * width for row in small for t in row], [accepts[m] for m in member], dead)


class Scanner:
    """Combined automaton of all rules, with each rule's own two for the span."""

    def __init__(self, rules: tuple[SecretRule, ...]):
        self.rules = rules
        self.dfa = compile_dfa([r.trigger or r.pattern for r in rules], anywhere=True)
        self.ahead = [compile_dfa([r.pattern], anywhere=False) for r in rules]
        self.back = [compile_dfa([r.trigger or r.pattern], anywhere=False, backwards=True) for r in rules]
        self.hits = {s * self.dfa.width: a for s, a in enumerate(self.dfa.accepts) if a}

    def accepted(self, data: bytes) -> list[tuple[int, int]]:
        """(end, premultiplied state) wherever some rule accepts: the one byte pass."""
        table, hits, state, out = self.dfa.table, self.hits, 0, []
        for at, c in enumerate(data.translate(self.dfa.classes)):
            state = table[state + c]
            if state in hits:
                out.append((at + 1, state))
        return out

    @staticmethod
    def _longest(dfa: Dfa, data: bytes, at: int, step: int, stop: int) -> int | None:
        """Bytes of the longest match from ``at`` in direction ``step``, if there is one."""
        state, best = 0, 0 if dfa.accepts[0] else None
        n = 0
        while at != stop:
            state = dfa.table[state + dfa.classes[data[at]]]
            if dfa.dead is not None and state == dfa.dead * dfa.width:
                break
            n += 1
            at += step
            if dfa.accepts[state // dfa.width]:
                best = n
        return best

    @staticmethod
    def _value_length(match: bytes) -> int:
        """Bytes of the value: what follows the first separator, its blanks and quote."""
        cut = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0)
        rest = match[cut + 1 :].lstrip(b" ")
        return len(rest[1:] if rest[:1] in (b'"', b"'") else rest)

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, sorted."""
        out, last = [], [0] * len(self.rules)
        for end, state in self.accepted(data):
            for rule in self.hits[state]:
                if end <= last[rule]:
                    continue
                back = self._longest(self.back[rule], data, end - 1, -1, last[rule] - 1)
                if not back:
                    continue
                start = end - back
                ahead = self._longest(self.ahead[rule], data, start, 1, len(data))
                if ahead is None:
                    continue
                stop = last[rule] = start + ahead
                r = self.rules[rule]
                if stop - start >= r.least and (not r.least_value or self._value_length(data[start:stop]) >= r.least_value):
                    out.append((start, rule, stop))
        return sorted(out)


@cache
def scanner(rules: tuple[SecretRule, ...]) -> Scanner:
    return Scanner(rules)


def _code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte spans as code point spans."""
    if data.isascii():
        return spans
    ends = np.cumsum(np.concatenate([[0], (np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80]).astype(np.int64))
    return [(int(ends[s]), r, int(ends[e])) for s, r, e in spans]


def scan_secrets(docs: DataFrame, added: tuple[SecretRule, ...] = ADDED_RULES) -> DataFrame:
    """(doc_id, found) per row: ``found`` lists (kind, start, end), by start, then rule.

    A null text is an empty one and has no spans; a null doc_id stays null;
    repeated rows each give a row; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    rules = BASE_RULES + tuple(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(rules)
        for b in batches:
            found = [[{"kind": rules[r].kind, "start": s, "end": e} for s, r, e in _code_points(body, scan.spans(body))] if body else [] for body in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, _FOUND)], ["doc_id", "found"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("body"))
    return rows.mapInArrow(run, "doc_id long, found array<struct<kind:string,start:long,end:long>>")


_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def secret_report(docs: DataFrame, added: tuple[SecretRule, ...] = ADDED_RULES) -> DataFrame:
    """Counts per base kind, the digest of the base spans, and all spans as text."""
    found = scan_secrets(docs, added)
    base = F.filter("found", lambda x: x["kind"].isin(*(r.kind for r in BASE_RULES)))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )


def sha256_of(spans: list[str]) -> str:
    """The digest that ``secret_report`` gives for these kind:start:end texts."""
    return hashlib.sha256(",".join(spans).encode()).hexdigest()
