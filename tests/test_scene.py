import random

import pytest
from gaze import frame, look, plain_scene, random_recording, two_images
from pyspark.sql import functions as F

from fixatio.functions import columns as C
from fixatio.operators import scene as S

CONFIG = [("a", "stimulus", ["sad face"]), ("b", "stimulus", ["happy face"]), ("c", " neutral ", []),
          ("d", "stimulus", ["Funeral", "happy"])]


@pytest.fixture(scope="module")
def stimuli(spark):
    df = spark.createDataFrame(CONFIG, "image_id string, category string, labels array<string>")
    return df.withColumn("folder", F.lit("set_0")).withColumn("valence", C.valence())


def metrics(df, stimuli, schedule=None, **kw):
    return S.scene_metrics(df, stimuli, schedule, keep_invalid_sessions=True, **kw)


def fixation_frame(spark, rows):
    fields = ("session_id string, folder string, scene_index int, fix_no long, start_timestamp double, "
              "end_timestamp double, duration_ms double, rx double, ry double, image string, "
              "onset_ms double")
    return spark.createDataFrame([("s", "set_0", 1, i + 1, *r, 0.0) for i, r in enumerate(rows)], fields)


def test_valence_rule(stimuli):
    got = {r["image_id"]: r["valence"] for r in stimuli.collect()}
    assert got == {"a": "negative", "b": "positive", "c": "neutral", "d": "negative"}


def test_labels_match_whole_and_untrimmed(spark):
    df = spark.createDataFrame(
        [("x", ["very sad"]), ("x", ["sad "]), ("Neutral", ["sad"]), (None, None)],
        "category string, labels array<string>")
    got = [r["v"] for r in df.select(C.valence().alias("v")).collect()]
    assert got == ["other", "other", "negative", "other"]


def test_two_image_scene(spark, stimuli):
    r = metrics(frame(spark, two_images()), stimuli).first()
    assert r["scene_valence_pair"] == "negative_vs_positive" and r["n_images"] == 2
    assert r["bias_neg_vs_pos"] == 0.0 and r["bias_neg_vs_neu"] is None
    assert (r["dwell_time_ms_negative"], r["dwell_time_ms_neutral"]) == (200.0, None)
    assert r["fixation_proportion_negative"] == pytest.approx(0.5)
    assert (r["ttff_ms_negative"], r["ttff_ms_positive"]) == (0.0, 320.0)
    assert r["first_fixation_valence"] == "negative" and r["schedule_provided"] is False
    assert r["fixation_count"] == 2 and r["saccade_count"] == 1


def test_no_fixations_gives_null_valence_but_zero_slots(spark, stimuli):
    df = frame(spark, [dict(ts=50 * i, image="ab"[i % 2]) for i in range(40)])
    r = metrics(df, stimuli).first()
    assert r["dwell_time_ms_negative"] is None and r["dwell_time_500ms_positive"] is None
    assert r["dwell_time_ms_img0"] == 0.0 and r["fixation_count_img1"] == 0.0
    assert r["transition_matrix_density"] == 0.0 and r["gaze_transition_entropy"] == 0.0
    assert r["scene_valence_pair"] == "negative_vs_positive" and r["scanpath_length"] == 0.0


def test_no_images(spark, stimuli):
    r = metrics(frame(spark, [dict(ts=50 * i) for i in range(40)]), stimuli).first()
    assert r["scene_valence_pair"] is None and r["transition_matrix_density"] is None
    assert r["n_images"] == 0 and r["fixation_rate_per_sec"] == 0.0


def test_schedule_wins_over_seen(spark, stimuli):
    plan = spark.createDataFrame([("set_0", 1, "c", "a")],
                                 "folder string, scene_index int, image_left_id string, image_right_id string")
    r = metrics(frame(spark, two_images()), stimuli, plan).first()
    assert r["image_ids"] == ["c", "a"] and r["unexpected_detected_images"] == ["b"]
    assert (r["valence_left"], r["valence_right"]) == ("neutral", "negative")
    # Shares are of the dwell on all images, those outside the schedule included.
    assert r["fixation_proportion_negative"] == pytest.approx(0.5)
    assert r["bias_neg_vs_neu"] == 1.0 and r["ttff_ms_neutral"] is None


def test_unknown_images(spark, stimuli):
    r = metrics(frame(spark, look(0, 200, "z")), stimuli).first()
    assert r["scene_valence_pair"] == "unknown" and r["dwell_time_ms_negative"] is None


def test_first_unseen_image_hides_the_valence(spark, stimuli):
    plan = spark.createDataFrame([("set_0", 1, "a", "d"), ("set_0", 3, "d", "a")],
                                 "folder string, scene_index int, image_left_id string, image_right_id string")
    df = frame(spark, look(0, 200, "d")).unionByName(frame(spark, look(0, 200, "d"), scene=3))
    one, three = metrics(df, stimuli, plan).orderBy("scene_index").collect()
    assert one["ttff_ms_negative"] is None and three["ttff_ms_negative"] == 0.0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_scenes_match_a_plain_loop(spark, stimuli, seed):
    rows = random_recording(random.Random(seed), 600, 8, images=("a", "b", "c", "d", None))
    got = metrics(frame(spark, rows), stimuli, block_rows=50).collect()
    valence = {"a": "negative", "b": "positive", "c": "neutral", "d": "negative"}
    assert len(got) == len({r["scene"] for r in rows})
    for g in got:
        part = [r for r in rows if r["scene"] == g["scene_index"]]
        images = sorted({r["image"] for r in part if r["image"]})
        want = plain_scene(part, images, valence)
        for k, v in want.items():
            assert g[k] == (None if v is None else pytest.approx(v, abs=1e-9)), (k, g["scene_index"])
        for b in ("bias_neg_vs_pos", "bias_neg_vs_neu", "bias_pos_vs_neu"):
            assert g[b] is None or -1 <= g[b] <= 1
        shares = [g[f"fixation_proportion_{v}"] or 0 for v in ("negative", "positive", "neutral")]
        assert sum(shares) <= 1 + 1e-9


@pytest.mark.parametrize("block", [1, 2, 100])
def test_scanpath_skips_points_without_both_coordinates(spark, block):
    f = fixation_frame(spark, [(0.0, 100.0, 100.0, 0.0, 0.0, "a"), (150.0, 250.0, 100.0, 100.0, None, "a"),
                               (300.0, 400.0, 100.0, 3.0, 4.0, "b")])
    r = S.general_metrics(f, block).first()
    assert r["scanpath_length"] == pytest.approx(5.0) and r["saccade_count"] == 2
    assert r["mean_saccade_amplitude"] == pytest.approx(5.0)


@pytest.mark.parametrize("block", [1, 2, 100])
def test_revisits_and_early_dwell(spark, block):
    f = fixation_frame(spark, [(0.0, 100.0, 100.0, 0.3, 0.6, "a"), (400.0, 700.0, 300.0, 0.7, 0.6, "b"),
                               (710.0, 720.0, 10.0, 0.3, 0.6, "a"), (721.0, 730.0, 9.0, 0.1, 0.1, None),
                               (731.0, 740.0, 9.0, 0.3, 0.6, "a")])
    got = {r["image"]: r for r in S.image_metrics(S.with_neighbour(f, block)).collect()}
    assert (got["a"]["revisit_count"], got["b"]["revisit_count"]) == (2, 0)
    assert (got["a"]["dwell_time_500ms"], got["b"]["dwell_time_500ms"]) == (100.0, 100.0)
    assert got["b"]["ttff_ms"] == 400.0 and got["a"]["dwell_time_ms"] == 119.0


def test_bias_extremes(spark, stimuli):
    a_only = metrics(frame(spark, look(0, 500, "a") + [dict(ts=600, image="b")]), stimuli).first()
    assert a_only["bias_neg_vs_pos"] == 1.0
    skew = look(0, 304, "a") + look(400, 96, "b")
    r = metrics(frame(spark, skew), stimuli).first()
    assert r["bias_neg_vs_pos"] == pytest.approx((304 - 96) / 400)


def test_one_file_name_in_two_folders(spark):
    from fixatio.operators import events as E

    a = frame(spark, look(0, 300, "a"))
    both = a.union(a.withColumn("folder", F.lit("set_9")))
    fixations = E.extract_fixations(both).collect()
    assert sorted(r.folder for r in fixations) == ["set_0", "set_9"]
    scenes = S.scene_metrics(both, keep_invalid_sessions=True).collect()
    assert sorted((r.folder, r.fixation_count) for r in scenes) == [("set_0", 1), ("set_9", 1)]
