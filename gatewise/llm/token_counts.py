"""Edit-aware token counts.

``count_trees`` cuts every text into segments of about ``leaf`` characters
whose bounds are pre-token bounds (a non-space character followed by a blank
or line feed), encodes each segment and keeps a segment tree per document: the
root holds the document's count, a leaf that of its segment.

``apply_edits`` takes (start, end, replacement) edits of a text and its tree.
A segment's bound stays a bound as long as the two characters beside it stay,
so an edit is widened to the segments that it touches, and to a neighbour when
it touches a character beside a bound.  Only that region of the new text is
encoded again; the leaves and the sums above them are updated.  The
count equals that of encoding the edited text afresh.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewise.llm.batches import bound_batches
from gatewise.llm.bpe import Encoder, encoder

LEAF = 512
_EDITS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("replacement", pa.string())]))


def bounds(text: str, leaf: int) -> list[int]:
    """Ends of the segments: the first safe bound at or after every ``leaf`` characters."""
    out, at = [], 0
    while len(text) - at > leaf:
        cut = at + leaf
        while cut < len(text) and not (text[cut] in " \n" and not text[cut - 1].isspace()):
            blank, line = text.find(" ", cut + 1), text.find("\n", cut + 1)
            cut = min(x for x in (blank, line, len(text)) if x > 0)
        if cut >= len(text):
            break
        out.append(cut)
        at = cut
    return [*out, len(text)] if text else []


def tree_of(leaves: list[int]) -> list[int]:
    """Heap of sums: node i has children 2i and 2i + 1, leaves start at len // 2."""
    width = 1
    while width < len(leaves):
        width *= 2
    tree = [0] * width + list(leaves) + [0] * (width - len(leaves))
    for i in range(width - 1, 0, -1):
        tree[i] = tree[2 * i] + tree[2 * i + 1]
    return tree


def _set_leaf(tree: list[int], leaf: int, value: int) -> None:
    at = len(tree) // 2 + leaf
    change = value - tree[at]
    while at:
        tree[at] += change
        at //= 2


def recount(bpe: Encoder, text: str, ends: list[int], tree: list[int], edits: list[tuple[int, int, str]]) -> tuple[int, int]:
    """Token count of the edited text, and the characters encoded for it.

    Edits are sorted, do not overlap and lie inside the text.  ``tree`` is
    updated in place: a run of touched segments keeps its new count in its
    first leaf, the others become empty.
    """
    if not ends:
        new = "".join(e[2] for e in edits)
        return bpe.count(new), len(new)
    runs: list[list] = []
    for edit in edits:
        start, end, _ = edit
        # the characters at start - 1 and end keep their neighbours only if no bound touches the edit
        first = max(0, bisect.bisect_left(ends, start))
        last = min(len(ends) - 1, bisect.bisect_right(ends, end))
        if first and start - ends[first - 1] <= 0:
            first -= 1
        if first and start <= ends[first - 1] + 1:  # the blank behind the bound is edited or gets a new neighbour
            first -= 1
        if runs and first <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], last)
            runs[-1][2].append(edit)
        else:
            runs.append([first, last, [edit]])
    encoded = 0
    for first, last, inside in runs:
        at, parts = (ends[first - 1] if first else 0), []
        for start, end, new in inside:
            parts += [text[at:start], new]
            at = end
        region = "".join([*parts, text[at : ends[last]]])
        encoded += len(region)
        _set_leaf(tree, first, bpe.count(region))
        for leaf in range(first + 1, last + 1):
            _set_leaf(tree, leaf, 0)
    return tree[1], encoded


def count_trees(docs: DataFrame, leaf: int = LEAF, path: str | None = None) -> DataFrame:
    """``docs`` (doc_id, text and, if given, edits) with ``ends`` and ``tree``.

    A null text has empty lists; other columns are dropped; every row is kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for b in batches:
            ends, trees = [], []
            for text in b.column("text").to_pylist():
                cuts = bounds(text or "", leaf)
                ends.append(cuts)
                trees.append(tree_of([bpe.count(text[a:e]) for a, e in zip([0, *cuts], cuts, strict=False)]) if cuts else [])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), b.column("edits"), pa.array(ends, pa.list_(pa.int64())), pa.array(trees, pa.list_(pa.int64()))], ["doc_id", "text", "edits", "ends", "tree"])

    bound_batches(docs.sparkSession)
    edits = F.col("edits") if "edits" in docs.columns else F.lit(None)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), edits.cast("array<struct<start:long,end:long,replacement:string>>").alias("edits"))
    return rows.mapInArrow(run, "doc_id long, text string, edits array<struct<start:long,end:long,replacement:string>>, ends array<long>, tree array<long>")


def apply_edits(state: DataFrame, path: str | None = None) -> DataFrame:
    """Counts before and after the edits of each row of ``count_trees``.

    Returns doc_id, n_tokens, n_edits, n_tokens_after, n_chars_after and
    n_chars_encoded.  Null edits are none; an edit that overlaps an earlier
    one, or lies outside the text, is clipped to what is left.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for b in batches:
            out = []
            for r in b.to_pylist():
                text, tree = r["text"] or "", r["tree"]
                edits, at = [], 0
                for e in sorted((e for e in r["edits"] or () if e), key=lambda e: (e["start"] or 0, e["end"] or 0)):
                    start = min(max(e["start"] or 0, at), len(text))
                    end = min(max(e["end"] or 0, start), len(text))
                    edits.append((start, end, e["replacement"] or ""))
                    at = end
                before = tree[1] if tree else 0
                after, encoded = recount(bpe, text, r["ends"], tree, edits) if edits else (before, 0)
                chars = len(text) + sum(len(n) - (e - s) for s, e, n in edits)
                out.append({"doc_id": r["doc_id"], "n_tokens": before, "n_edits": len(edits), "n_tokens_after": after, "n_chars_after": chars, "n_chars_encoded": encoded})
            yield pa.RecordBatch.from_pylist(out, schema=_OUT)

    return state.mapInArrow(run, "doc_id long, n_tokens long, n_edits long, n_tokens_after long, n_chars_after long, n_chars_encoded long")


_OUT = pa.schema([(k, pa.int64()) for k in ("doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_chars_after", "n_chars_encoded")])

#: What the registered query edits: personal data and repeated words, as a cleaning pass would.
MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"
DIGITS = r"(?<![\w.])\d{12,19}(?!\w)"
REPEAT = r"(\b\w+\b)(?: \1\b){3,}"


def cleaning_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, text, edits): e-mails and long numbers replaced, runs of one word reduced to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = re.compile(f"(?P<mail>{MAIL})|(?P<digits>{DIGITS})|(?P<repeat>{REPEAT.replace('1', '4')})")
        assert rules.groups == 4
        for b in batches:
            found = []
            for text in b.column(1).to_pylist():
                found.append([{"start": m.start(), "end": m.end(), "replacement": m.group(4) if m.group("repeat") else f"<{m.lastgroup}>"} for m in rules.finditer(text or "")])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, _EDITS)], ["doc_id", "text", "edits"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, text string, edits array<struct<start:long,end:long,replacement:string>>")
