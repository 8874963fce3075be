"""Licence notices that are hard-wrapped, as in real files."""

import textwrap

from gatewise.llm import licenses


def test_wrapped_notices(spark):
    rows, want = [], []
    for width in (20, 40, 72):
        for label, text in licenses.TEMPLATES:
            lines = textwrap.wrap(text, width)
            rows.append((len(rows), "some code\n" + "\n".join(f" * {line}" for line in lines) + "\nmore code"))
            want.append(label)
    rows.append((len(rows), "all of it\nis under some rights that\nwe never reserved"))  # words that stand apart
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, label in enumerate(want):
        assert label in got[i].labels.split(",") and got[i].score == 1.0, rows[i]
    assert (got[len(want)].labels, got[len(want)].score) == ("", 0.0)


def test_wrapped_notice_with_other_words(spark):
    mit = next(t for label, t in licenses.TEMPLATES if label == "mit" and "granted" in t)
    text = "\n".join(textwrap.wrap(mit.replace("charge", "cost").replace("obtaining a copy", "obtaining or using a copy"), 30))
    (r,) = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert r.labels == "mit" and 0.9 <= r.score < 1
