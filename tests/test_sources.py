import json

import pytest
from gaze import gap, look

from fixatio import model as M
from fixatio.plans import build
from fixatio.sources import raw
from fixatio.sources import tables as TB

HEAD = ",TIMESTAMP,TEV,FEV,FDUR,FPOGX,FPOGY,RX,RY,BLINK,IMAGE,SCENE_INDEX"


def line(i, r):
    gaze = ["" if r.get(k, 0.5) is None else r.get(k, 0.5) for k in ("rx", "ry")]
    return ",".join(map(str, [i, r["ts"], 1, r.get("fev", 0), r.get("fdur", 0.0), *gaze, *gaze,
                              r.get("blink", False), r.get("image") or "no_image", r.get("scene", 1)]))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    for name in ("set_a", "set_b"):
        (root / "rec" / name).mkdir(parents=True)
    rows = []
    for scene in range(1, 13):
        t = 3000 * scene
        part = look(t, 300, "i1") + gap(t + 310, 60) + look(t + 400, 700, "i2") + look(t + 1200, 900, "i1")
        rows += [{**r, "scene": scene} for r in part]
    text = [HEAD, *[line(i, r) for i, r in enumerate(rows)]]
    (root / "rec" / "set_a" / "s 1.csv").write_text("\n".join(text + [",9,1,1,,,,,,,,"]) + "\n")
    bad = [HEAD, "0,0,1,x,oops,,nan,,0.5,,i1,1", "1,16,1,3,5,0.1,0.2,0.3,0.4,True,nan,1"]
    (root / "rec" / "set_b" / "s2.csv").write_text("\n".join(bad) + "\n")
    pairs = [{"i1": {"category": "stimulus", "labels": ["Sad"], "url": "u"},
              "i2": {"category": " neutral", "labels": []}},
             {"i2": {"category": "stimulus", "labels": ["Happy"]}, "i3": {"category": "x", "labels": ["y"]}}]
    (root / "cfg").mkdir()
    (root / "cfg" / "set_a.json").write_text(json.dumps(pairs))
    (root / "cfg" / "set_b.json").write_text(json.dumps(pairs[:1]))
    forms = ["Unnamed: 0,sid,uid,phq-9_1,phq-9_score,bdi_21,bdi_score,createdAt",
             "0,s 1,u1,2,12,1,30,2024-01-02 03:04:05", "1,zz,u2,,,0,7,never"]
    (root / "forms.csv").write_text("\n".join(forms) + "\n")
    return root


def test_samples(spark, folder):
    df = raw.read_samples(spark, str(folder / "rec"))
    assert df.schema.fieldNames() == M.SAMPLE_SCHEMA.fieldNames()
    assert df.filter("scene_index is null").count() == 0
    a, b = df.filter("session_id = 's2'").orderBy("sample_idx").collect()
    assert (a["fev"], a["fdur"], a["rx"], a["ry"], a["blink"]) == (None, None, None, 0.5, True)
    assert (b["blink"], b["image"], b["folder"]) == (True, None, "set_b")
    assert df.select("session_id").distinct().count() == 2


def test_session_files(spark, folder):
    got = sorted(map(tuple, raw.session_files(spark, str(folder / "rec")).collect()))
    assert got == [("s 1", "set_a"), ("s2", "set_b")]


def test_stimuli_last_entry_wins(spark, folder):
    got = {(r["folder"], r["image_id"]): r for r in raw.read_stimuli(spark, str(folder / "cfg")).collect()}
    assert len(got) == 5
    assert got["set_a", "i2"]["valence"] == "positive" and got["set_b", "i2"]["valence"] == "neutral"
    assert got["set_a", "i1"]["url"] == "u" and got["set_a", "i3"]["valence"] == "other"


def test_single_object_config(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"z": {"category": "neutral", "labels": []}}))
    assert raw.read_stimuli(spark, str(tmp_path)).first()["valence"] == "neutral"
    with pytest.raises(Exception, match="list of pairs"):
        raw.read_schedule(spark, str(tmp_path)).collect()


def test_schedule(spark, folder, tmp_path):
    got = sorted(map(tuple, raw.read_schedule(spark, str(folder / "cfg")).collect()))
    assert got == [("set_a", 1, "i1", "i2"), ("set_a", 3, "i2", "i3"), ("set_b", 1, "i1", "i2")]
    (tmp_path / "x.json").write_text(json.dumps([{"a": {}, "b": {}, "c": {}}]))
    with pytest.raises(Exception, match="expected 2 images, got 3"):
        raw.read_schedule(spark, str(tmp_path)).collect()


def test_build_all(spark, folder, tmp_path):
    t = {n: str(tmp_path / n) for n in ("stimuli", "forms", "sessions", "fixations", "rows", "scenes")}
    build.build_stimuli(spark, str(folder / "cfg"), t["stimuli"])
    build.build_forms(spark, str(folder / "forms.csv"), t["forms"])
    build.build_sessions(spark, str(folder / "rec"), t["forms"], t["sessions"])
    gates = M.Gates(session_min_samples=100, session_min_seconds=10)
    build.build_scene_metrics(spark, str(folder / "rec"), str(folder / "cfg"), t["fixations"],
                              t["rows"], t["scenes"], gates)
    f = {r["session_id"]: r for r in TB.read_table(spark, t["forms"]).collect()}
    assert (f["s 1"]["phq9_severity"], f["s 1"]["bdi_severity"]) == ("moderate", "severe")
    assert f["zz"]["phq9_severity"] is None and f["s 1"]["phq9_q1"] == 2 and f["s 1"]["bdi_q21"] == 1
    s = {r["session_id"]: r["uid"] for r in TB.read_table(spark, t["sessions"]).collect()}
    assert s == {"s 1": "u1", "s2": None}
    m = TB.read_table(spark, t["scenes"]).orderBy("scene_index").collect()
    assert len(m) == 12 and {r["session_id"] for r in m} == {"s 1"}
    assert json.loads(m[0]["image_ids"]) == ["i1", "i2"] and m[0]["folder"] == "set_a"
    assert m[0]["fixation_count"] == 3 and m[0]["image_left_id"] == "i1"
    assert m[1]["schedule_provided"] is False and m[0]["scene_quality_valid"] is True
    again = TB.read_table(spark, t["stimuli"])
    assert json.loads(again.filter("image_id = 'i1'").first()["labels"]) == ["Sad"]


def test_tidy_text(spark):
    df = spark.createDataFrame([("nan", 1), ("None", 2), ("ok", 3)], "a string, b int")
    assert [r["a"] for r in TB.tidy_text(df).orderBy("b").collect()] == [None, None, "ok"]


def test_headers_are_read_by_name_for_each_file(spark, tmp_path):
    """Files with and without the row number, in other column order, and one name in two folders."""
    body = [(16 * i, i % 2) for i in range(6)]
    for folder in ("set_a", "set_b", "set_c"):
        (tmp_path / folder).mkdir()
    indexed = [HEAD, *[f"{i},{t},1,{f},9,0.1,0.2,0.3,0.4,False,i1,1" for i, (t, f) in enumerate(body)]]
    indexed[3] = "oops" + indexed[3][1:]
    (tmp_path / "set_a" / "s.csv").write_text("\n".join(indexed) + "\n")
    plain = "IMAGE,SCENE_INDEX,TIMESTAMP,FEV"
    (tmp_path / "set_b" / "s.csv").write_text("\n".join([plain, *[f"i2,3,{t},{f}" for t, f in reversed(body)]]) + "\n")
    (tmp_path / "set_c" / "q.csv").write_text("\n".join(['"",TIMESTAMP,SCENE_INDEX', '4,"8",5']) + "\n")
    rows = raw.read_samples(spark, str(tmp_path)).collect()
    by = {f: sorted((r for r in rows if r.folder == f), key=lambda r: r.sample_idx) for f in ("set_a", "set_b", "set_c")}
    assert [r.sample_idx for r in by["set_a"]] == [-1, 0, 1, 3, 4, 5] and by["set_a"][0].timestamp_ms == 32
    assert [(r.sample_idx, r.timestamp_ms) for r in by["set_b"]] == [(i, 16.0 * i) for i in range(6)]
    assert {(r.fdur, r.image, r.scene_index) for r in by["set_b"]} == {(None, "i2", 3)}
    assert [(r.sample_idx, r.timestamp_ms, r.blink, r.scene_index) for r in by["set_c"]] == [(4, 8.0, True, 5)]
    (tmp_path / "set_c" / "none.csv").write_text("1,2,3\n")
    with pytest.raises(Exception, match="no header"):
        raw.read_samples(spark, str(tmp_path)).collect()


def test_configurations_and_recordings_in_parts(spark, tmp_path):
    """A list spread over files, with positions beside it, reads as the one file does; so does a
    recording in a folder of its own."""
    entry = {"a": {"category": "stimulus", "labels": ["sad"]}, "b": {"category": " neutral ", "labels": [], "url": "u"}}
    other = {"b": {"category": "stimulus", "labels": ["Happy Face"]}, "c": {"category": "neutral", "labels": []}}
    whole, parts = tmp_path / "whole", tmp_path / "parts" / "set=s 1"
    whole.mkdir()
    parts.mkdir(parents=True)
    (whole / "s 1.json").write_text(json.dumps([entry, other]))
    (parts / "part-1.txt").write_text(json.dumps({"position": 1, "images": other}))
    (parts / "part-0.txt").write_text(json.dumps({"position": 0, "images": entry}))
    for read in (raw.read_stimuli, raw.read_schedule):
        a, b = read(spark, str(whole)).collect(), read(spark, str(tmp_path / "parts"), in_parts=True).collect()
        assert sorted(map(str, a)) == sorted(map(str, b)) and a
    (parts / "part-2.txt").write_text(json.dumps({"images": entry}))
    with pytest.raises(Exception, match="without a position"):
        raw.read_schedule(spark, str(tmp_path / "parts"), in_parts=True).collect()
    head = ",TIMESTAMP,TEV,FEV,FDUR,FPOGX,FPOGY,RX,RY,BLINK,IMAGE,SCENE_INDEX\n"
    for place in ("one/v1/x.csv", "many/v1/session=x/part-0.csv", "many/v1/session=x/part-1.csv"):
        path = tmp_path / place
        path.parent.mkdir(parents=True, exist_ok=True)
        rows = [f"{i},{i}.5,1,0,0,0.1,0.2,None,nan,0,img,1\n" for i in range(4)]
        path.write_text(head + "".join(rows if "one" in place else rows[:2] if "part-0" in place else rows[2:]))
    one, many = (sorted(map(str, raw.read_samples(spark, str(tmp_path / d)).collect())) for d in ("one", "many"))
    assert one == many and len(one) == 4
    assert {tuple(r) for r in raw.session_files(spark, str(tmp_path / "many")).collect()} == {("x", "v1")}


def test_files_of_recordings_follow_from_sessions(spark, tmp_path, monkeypatch):
    """Samples of a session in many tasks make one file, and none is lost."""
    from pathlib import Path

    from pyspark.sql import functions as F

    from fixatio.plans import source_queries as Q

    n = 3 * 200
    rows = spark.range(n).repartition(20).select(
        (F.col("id") % 3).cast("string").alias("session_id"), F.concat(F.lit("set_"), F.col("id") % 3).alias("folder"),
        F.floor(F.col("id") / 3).alias("sample_idx"), F.col("id").cast("double").alias("timestamp_ms"), F.lit(1.0).alias("tev"),
        F.lit(0.0).alias("fev"), F.lit(64.0).alias("fdur"), F.lit(0.5).alias("fpogx"), F.lit(0.5).alias("fpogy"),
        F.when(F.col("id") % 7 > 0, 0.25).alias("rx"), F.lit(0.75).alias("ry"), (F.col("id") % 2 == 0).alias("blink"),
        F.when(F.col("id") % 5 == 0, "a, \"b\"").alias("image"), F.lit(1).alias("scene_index"),
    )
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.option("maxPartitionBytes", 1000).parquet(str(tmp_path / "rows"))
    monkeypatch.setattr(Q.I, "samples", lambda spark, d: rows.repartition(20))
    monkeypatch.setattr(Q, "new_folder", lambda spark, name: str(tmp_path / name))
    assert Q.files_inventory(spark, "any").count() == 3
    assert len(list(Path(tmp_path / "recordings").rglob("*.csv"))) == 3
    monkeypatch.setattr(Q, "new_folder", lambda spark, name: str(tmp_path / "again"))
    monkeypatch.setattr(Q, "FILE_SAMPLES", 50)  # a long session in several files
    found = Q.files_samples(spark, "any")
    assert sorted(map(str, found.collect())) == sorted(map(str, rows.select(*found.columns).collect()))


def test_images_are_not_sent_to_all_tasks(spark, tmp_path, monkeypatch):
    """The pairs of a configuration meet their images by key, whatever the size of the files."""
    from fixatio.plans import source_queries as Q

    meta = [(f"i{k}", "set_0", "neutral", ["a"], f"img://{k}") for k in range(40)]
    images = spark.createDataFrame(meta, "image_id string, folder string, category string, labels array<string>, url string")
    pairs = spark.createDataFrame([("set_0", 2 * k + 1, f"i{k}", f"i{39 - k}") for k in range(20)],
                                  "folder string, scene_index int, image_left_id string, image_right_id string")
    images.write.parquet(str(tmp_path / "images"))
    images = spark.read.parquet(str(tmp_path / "images"))  # of known size
    plans, store, number = [], getattr(Q, "keep", lambda df: df), Q.B.number_rows
    seen = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(Q.I, "stimuli", lambda spark, d: images)
    monkeypatch.setattr(Q.I, "schedule", lambda spark, d: pairs)
    monkeypatch.setattr(Q, "new_folder", lambda spark, name: str(tmp_path / name))
    monkeypatch.setattr(Q, "keep", lambda df: (seen(df), store(df))[1], raising=False)
    monkeypatch.setattr(Q.B, "number_rows", lambda df, *a: (seen(df), number(df, *a))[1])
    found = sorted(tuple(r) for r in Q.files_schedule(spark, "any").collect())
    assert found == sorted(("set_0", 2 * k + 1, f"i{k}", f"i{39 - k}") for k in range(20))
    assert any("Join" in p for p in plans) and not any("Broadcast" in p for p in plans)
