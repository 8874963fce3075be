"""Pipeline stages decide row by row; held tables are given back."""

import pytest

from gatewise.llm import decontam, store

ITEM = "the quick brown fox jumps over the lazy dog near the river bank"


def test_leaks_are_dropped_row_by_row(spark):
    rows = [(1, "x", f"start {ITEM} end"), (1, "y", "a clean text under the same id"), (None, "z", ITEM.upper()), (None, "w", "clean"), (2, "n", None), (3, "e", ""), (4, "p", " ".join(ITEM.split()[:6]))]
    docs = spark.createDataFrame(rows, "doc_id long, item_id string, text string")
    items = spark.createDataFrame([(9, ITEM), (10, None), (11, "")], "item_id long, text string")
    kept = decontam.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r["item_id"] for r in kept.collect()) == ["e", "n", "p", "w", "y"]
    assert decontam.drop_contaminated(docs, items.limit(0)).count() == len(rows)
    assert decontam.drop_contaminated(docs.limit(0), items).count() == 0


@pytest.mark.parametrize("chars", [10, 32_000_000])
def test_leaks_by_blocks_of_items(spark, monkeypatch, chars):
    monkeypatch.setattr(decontam, "BLOCK_CHARS", chars)
    docs = spark.createDataFrame([(i, f"w{i} " + ITEM.replace("fox", f"fox{i % 7}")) for i in range(40)], "doc_id long, text string")
    items = spark.createDataFrame([(i, ITEM.replace("fox", f"fox{i}")) for i in range(3)], "item_id long, text string")
    held = {r["doc_id"] for r in decontam.contained_items(docs, items).collect()}
    assert {r["doc_id"] for r in decontam.drop_contaminated(docs, items).collect()} == set(range(40)) - held


def test_release_gives_back_what_is_held(spark):
    store.release()
    a = store.hold(spark.range(10))
    assert a.count() == 10 and a.is_cached
    store.release()
    assert not store._HELD and not a.is_cached and a.count() == 10
