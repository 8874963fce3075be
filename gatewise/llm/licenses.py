"""License scan: base phrases, and an exact set-similarity join with templates.

A text block is a line, or a window of the text that is as long as a template
of m words with a tenth more (m / share words, over any line ends), so that
hard-wrapped notices count as those on one line do.  Its set is its distinct
words, a template's its own.  A block carries a template's label when it
contains at least ``share`` of the template's words.  The join is exact; the
windows of a text are slid only for templates that the text as a whole
contains:

* words are ordered by how many blocks of the whole table hold them, rarest
  first (counted over all documents);
* *prefix*: of a template's n words a block may miss ``n - ceil(share n)``, so
  it holds one of the first ``n - ceil(share n) + 1``;
* *length*: a block with fewer distinct words than the template needs is out;
* *position*: after the first shared word at position i at most ``n - i``
  words can be shared.

Templates are a fixed table of this module, so the index is small by design.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewise.llm.batches import bound_batches

SHARE = (9, 10)

# Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Licence notices by label.
TEMPLATES = (
    ("apache", "Licensed under the Apache License Version 2 0"),
    ("apache", "you may not use this file except in compliance with the License you may obtain a copy of the License at www apache org licenses"),
    ("bsd", "Redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "Licensed under CC BY 4 0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4 0 International License"),
    ("cc-by-nc", "Licensed under CC BY NC 4 0"),
    ("cc-by-sa", "Licensed under CC BY SA 4 0"),
    ("gpl", "This work is licensed under the GNU General Public License version 3"),
    ("gpl", "This program is free software you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License v 2 0"),
    ("reserved", "All rights reserved"),
)

#: A-Z to a-z; 0-9, a-z and every byte of a non-ASCII character stay; the rest is a blank.
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_KEEP).split()


def template_words(text: str) -> list[bytes]:
    return sorted(set(words_of(text.encode())))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("body"))


def block_frequencies(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """(word, blocks): how many blocks of all documents hold each template word."""
    vocabulary = frozenset(w for _, t in templates for w in template_words(t))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for body in b.column(1).to_pylist():
                for line in (body or b"").split(b"\n"):
                    seen.update(vocabulary.intersection(words_of(line)))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "blocks"])

    return _rows(docs).mapInArrow(run, "word string, blocks long").groupBy("word").agg(F.sum("blocks").alias("blocks"))


class TemplateIndex:
    """Prefix index of the templates under a word order."""

    def __init__(self, templates: tuple[tuple[str, str], ...], frequency: dict[bytes, int], share: tuple[int, int]):
        self.templates, self.index = [], {}
        for label, text in templates:
            words = sorted(template_words(text), key=lambda w: (frequency.get(w, 0), w))
            need = -(-share[0] * len(words) // share[1])
            for at, word in enumerate(words[: len(words) - need + 1]):
                self.index.setdefault(word, []).append((len(self.templates), at))
            self.templates.append((label, words, need, -(-len(words_of(text.encode())) * share[1] // share[0])))
        self.prefixes = frozenset(self.index)

    def match(self, block: list[bytes]) -> list[tuple[str, float]]:
        """(label, containment) of the templates that the block contains."""
        return [(self.templates[t][0], shared / len(self.templates[t][1])) for t, shared in self._contained(set(block))]

    def match_windows(self, text: list[bytes]) -> list[tuple[str, float]]:
        """(label, containment) of the templates that a window of the text contains."""
        out = []
        for template, _ in self._contained(set(text)):
            label, ordered, need, width = self.templates[template]
            own, held, shared, back = set(ordered), Counter(), 0, 0
            places = [i for i, w in enumerate(text) if w in own]
            for i in places:
                held[text[i]] += 1
                while places[back] <= i - width:
                    gone = text[places[back]]
                    held[gone] -= 1
                    if not held[gone]:
                        del held[gone]
                    back += 1
                shared = max(shared, len(held))
            if shared >= need:
                out.append((label, shared / len(ordered)))
        return out

    def _contained(self, words: set[bytes]) -> list[tuple[int, int]]:
        """(template, shared words) of the templates that a set of words contains."""
        first: dict[int, int] = {}
        for word in self.prefixes & words:
            for template, at in self.index[word]:
                first[template] = min(at, first.get(template, at))
        out = []
        for template, at in first.items():
            _, ordered, need, _ = self.templates[template]
            if len(words) < need or len(ordered) - at < need:  # length and positional filters
                continue
            shared = sum(w in words for w in ordered[at:])
            if shared >= need:
                out.append((template, shared))
        return out


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, share: tuple[int, int] = SHARE) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is 1 where a base phrase stands, else the largest containment
    that meets the threshold, else 0.  A null text is an empty one; repeated
    rows give a row each; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    frequency = {r[0].encode(): r[1] for r in block_frequencies(docs, templates).collect()}  # one row per template word
    index = TemplateIndex(templates, frequency, share)
    phrases = [(p.encode().split(), label) for p, label in BASE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(body or b"")
                starts, base, labels, score = [], set(), set(), 0.0
                present = set(words)
                if b"license" in present:
                    for phrase, label in phrases:
                        if present.issuperset(phrase):
                            places = [i for i, w in enumerate(words) if w == phrase[0] and words[i : i + len(phrase)] == phrase]
                            starts += places
                            base.update([label] * bool(places))
                if index.prefixes & present:
                    found = [hit for line in body.split(b"\n") for hit in index.match(words_of(line))]
                    for label, part in found + index.match_windows(words):
                        labels.add(label)
                        score = max(score, part)
                if base:
                    score = 1.0
                out.append((doc, len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(_OUT)], schema=_OUT)

    return _rows(docs).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])
