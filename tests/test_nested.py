import json

from cadenza.operators.nested import dewey_nodes, flat_table, walk
from cadenza.plans import pages

PAGE = {
    "metadata": {"page": 3},
    "payload": {
        "recenttracks": {
            "track": [
                {"name": "One", "artist": {"#text": "A", "mbid": " AB "}, "credits": {"artist": [{"mbid": "x"}, "text"], "members": {"mbid": "m1"}}},
                "not an object",
                {"name": "Two", "mbid": "track", "artist": [{"mbid": ""}, {"mbid": "ab"}, {"mbid": None}], "album": {"mbid": "album"}, "credits": [{"members": [{"mbid": "m2"}, {"mbid": "m2"}]}, None, 5]},
            ],
            "@attr": {"page": "9", "user": "u"},
        }
    },
}
LONE = {"payload": {"recenttracks": {"track": {"name": "Three", "artist": {"mbid": "c"}, "@attr": {"nowplaying": "true"}}, "@attr": {"page": "7", "totalPages": "8"}}}}


def frame(spark):
    rows = [("r1", json.dumps({"pages": [PAGE, LONE, PAGE]})), ("r2", None), ("r3", '{"pages": ['), ("r4", "null"), ("r5", ""), ("r6", json.dumps({"pages": LONE})), ("r7", "[" * 50_000)]
    return spark.createDataFrame(rows, "run_id string, payload string")


def test_found(spark):
    got = {tuple(r) for r in pages.artist_ids(frame(spark)).collect()}
    first = {("r1", 3, 0, "ab"), ("r1", 3, 0, "x"), ("r1", 3, 0, "m1"), ("r1", 3, 2, "ab"), ("r1", 3, 2, "m2"), ("r1", 7, 0, "c")}
    assert got == first | {("r6", 7, 0, "c")}


def test_tables_are_linked(spark):
    df = frame(spark)
    p, t, a = pages.page_table(df), pages.track_table(df), pages.reference_table(df)
    assert p.count() == 4
    assert sorted(r.track_pos for r in t.where("run_id = 'r1'").collect()) == [0, 0, 0, 2, 2]
    assert a.join(t.withColumnRenamed("label", "track_label"), ["run_id", "track_label"], "left_anti").count() == 0
    assert t.join(p.withColumnRenamed("label", "page_label"), ["run_id", "page_label"], "left_anti").count() == 0


def test_labels_and_parents(spark):
    nodes = list(walk({"a": [{"b": 1}, [2, None]], "c": {"b": True}}))
    labels = {lab for _, lab, _, _ in nodes}
    assert all(lab[:-2] in labels for lab in labels if lab)
    assert len(labels) == len(nodes)


def test_odd_documents(spark):
    rows = [("k", '{"a": "\\ud800x", "b/c~": 1e400, "d": [], "e": {}}'), ("k2", "7")]
    df = spark.createDataFrame(rows, "path string, value string")
    got = [tuple(r) for r in dewey_nodes(df, "path", "value").select("doc_key", "path", "kind", "value").collect()]
    assert ("k", "/a", "string", "?x") in got
    assert ("k", "/b~1c~0", "number", "inf") in got
    assert ("k2", "", "number", "7") in got
    assert dewey_nodes(df.limit(0), "path", "value").count() == 0


def test_flat_table_keeps_empty_objects(spark):
    df = spark.createDataFrame([("d", '{"x": [{"y": 1}, {}, 5, {"y": {"z": 2}}]}')], "id string, doc string")
    t = flat_table(dewey_nodes(df, "id", "doc"), "/x", {"y": "y", "z": "y/z"})
    assert sorted((r.label[1], r.y, r.z) for r in t.collect()) == [(0, "1", None), (1, None, None), (3, None, "2")]
