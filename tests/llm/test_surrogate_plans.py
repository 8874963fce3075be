"""Plans of the surrogates stay small: no cached plan is repeated inside another."""

from gatewise.llm import surrogates as S


def test_no_cached_plans_inside_plans(spark, monkeypatch):
    seen = []
    write = S.materialize

    def noted(df, name="stage"):
        seen.append(df._jdf.queryExecution().toString())
        return write(df, name)

    monkeypatch.setattr(S, "materialize", noted)
    rows = [(1, "write to ann.lee@mail.example or Dr Ann Lee"), (2, "Mrs Ann Lee at 10.1.2.3, card 4111 1111 1111 1111"), (3, "nothing here"), (4, None)]
    out = S.surrogate_texts(spark.createDataFrame(rows, "doc_id long, text string"))
    seen.append(out._jdf.queryExecution().toString())
    got = {r["doc_id"]: r for r in out.collect()}
    assert seen and not any("InMemoryRelation" in plan for plan in seen)
    assert got[1]["n_entities"] >= 2 and "ann.lee" not in got[1]["text"]
    assert got[2]["n_entities"] >= 3 and "10.1.2.3" not in got[2]["text"]
    assert got[3]["text"] == "nothing here" and got[4]["text"] is None
    ann = got[1]["text"].split("Dr ")[1].split()[0]
    assert f"Mrs {ann} " in got[2]["text"]
