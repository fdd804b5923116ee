from cadenza.llm.charform import in_form, not_in_form


def test_frames(spark):
    rows = [(1, "\uff41", "b", None), (1, "\uff41", "b", None), (2, None, "x\u00a0y", "ok"), (3, "", "e\u0301", "Ланвелпот"), (4, "x" * 100_000 + "\u200b", "y", "z")]
    df = spark.createDataFrame(rows, "row_no bigint, field_name string, a string, b string")
    got = sorted(map(tuple, not_in_form(df, "row_no", ["field_name", "a", "b"]).collect()))
    assert got == [(1, "field_name"), (1, "field_name"), (2, "a"), (3, "a"), (4, "field_name")]
    clean = in_form(df, ["field_name", "a"]).collect()
    assert [r.field_name for r in clean] == ["a", "a", None, "", "x" * 100_000]
    assert [r.a for r in clean] == ["b", "b", "x y", "\u00e9", "y"]
    assert not_in_form(in_form(df, ["field_name", "a"]), "row_no", ["field_name", "a"]).count() == 0
    assert not_in_form(df.limit(0), "row_no", ["a"]).count() == 0
