"""Small gaze recordings, and plain-Python answers to check the Spark operators against."""

import math
from collections import Counter

FIELDS = ("session_id string, folder string, sample_idx long, timestamp_ms double, tev double, "
          "fev double, fdur double, fpogx double, fpogy double, rx double, ry double, "
          "blink boolean, image string, scene_index int")


def sample(i, ts, *, fev=0, fdur=0.0, rx=0.5, ry=0.5, image=None, blink=False, scene=1, sid="s",
           folder="set_0"):
    if blink:
        rx = ry = None
    return (sid, folder, i, float(ts), 1.0, float(fev), float(fdur), rx, ry, rx, ry, blink, image,
            scene)


def look(start, ms, image, rx=0.3, ry=0.5, step=16.0):
    """Keyword rows of one fixation: a start, middle samples, an end that holds the duration."""
    n = max(2, round(ms / step))
    return [dict(ts=start + k * step, fev=1 if k == 0 else 3 if k == n - 1 else 2,
                 fdur=ms if k == n - 1 else 0.0, rx=rx, ry=ry, image=image) for k in range(n)]


def gap(start, ms, step=16.0):
    return [dict(ts=start + k * step, rx=None, ry=None) for k in range(max(1, round(ms / step)))]


def frame(spark, parts, **common):
    rows = [sample(i, **{**common, **p}) for i, p in enumerate(parts)]
    return spark.createDataFrame(rows, FIELDS)


def two_images():
    return look(0, 200, "a", 0.3, 0.6) + gap(210, 100) + look(320, 200, "b", 0.7, 0.6)


def random_recording(rng, n, scenes, images=("a", "b", None)):
    """Keyword rows with random markers, gaps, blinks and images; scenes come in stretches."""
    rows, scene = [], 1
    for i in range(n):
        if rng.random() < scenes / n:
            scene += 1
        miss = rng.random() < 0.2
        rows.append(dict(
            ts=i * 10.0 + rng.randrange(3), fev=rng.choice([0, 1, 1, 2, 3, 3]),
            fdur=rng.randrange(1, 500), rx=None if miss else rng.random(),
            ry=None if miss else rng.random(), image=rng.choice(images),
            blink=rng.random() < 0.3, scene=scene,
        ))
    return rows


def mean(xs):
    xs = [x for x in xs if x is not None]
    return sum(xs) / len(xs) if xs else None


def plain_fixations(rows):
    """Oldest open start takes the next end; rows are those of one scene."""
    open_, out = [], []
    for pos, r in enumerate(rows):
        if r["fev"] == 1:
            open_.append(pos)
        elif r["fev"] == 3 and open_:
            out.append((open_.pop(0), pos))
    result = []
    for s, e in out:
        part = rows[s: e + 1]
        gaze = [(None, None) if p.get("blink") else (p["rx"], p["ry"]) for p in part]
        seen = Counter(p["image"] for p in part if p["image"])
        first = {}
        for k, p in enumerate(part):
            first.setdefault(p["image"], k)
        image = min(seen, key=lambda i: (-seen[i], first[i])) if seen else None
        result.append(dict(t0=rows[s]["ts"], t1=rows[e]["ts"], dur=float(rows[e]["fdur"]),
                           rx=mean(g[0] for g in gaze), ry=mean(g[1] for g in gaze), image=image,
                           n=e - s + 1))
    return result


def plain_blinks(rows):
    out, start = [], None
    for pos, r in enumerate(rows):
        if r["blink"] and start is None:
            start = pos
        if not r["blink"] and start is not None:
            out.append((start, pos))
            start = None
    if start is not None:
        out.append((start, len(rows) - 1))
    return [(rows[s]["ts"], rows[e]["ts"], e - s) for s, e in out]


def plain_scene(rows, images, valence):
    """A few metrics of one scene, computed row by row."""
    fx = plain_fixations(rows)
    out = {"fixation_count": len(fx), "blink_count": len(plain_blinks(rows))}
    pts = [(f["rx"], f["ry"]) for f in fx if f["rx"] is not None and f["ry"] is not None]
    out["scanpath_length"] = sum(math.dist(p, q) for p, q in zip(pts, pts[1:]))
    onset = rows[0]["ts"]
    dwell = Counter()
    visits, early, ttff, last = Counter(), Counter(), {}, None
    for f in fx:
        i = f["image"]
        if i is not None:
            dwell[i] += f["dur"]
            visits[i] += i != last
            early[i] += max(0.0, min(f["t1"], onset + 500) - max(f["t0"], onset))
            ttff.setdefault(i, f["t0"] - onset)
        last = i
    total = sum(dwell.values())
    for v in ("negative", "positive", "neutral"):
        mine = [i for i in images if valence[i] == v]
        if not mine or not fx:
            for m in ("dwell_time_ms", "revisit_count", "ttff_ms", "dwell_time_500ms",
                      "fixation_proportion"):
                out[f"{m}_{v}"] = None
            continue
        out[f"dwell_time_ms_{v}"] = sum(dwell[i] for i in mine)
        out[f"revisit_count_{v}"] = sum(max(0, visits[i] - 1) for i in mine)
        out[f"dwell_time_500ms_{v}"] = sum(early[i] for i in mine)
        out[f"fixation_proportion_{v}"] = sum(dwell[i] for i in mine) / total if total else 0.0
        seen = [ttff[i] for i in mine if i in ttff]
        out[f"ttff_ms_{v}"] = min(seen) if mine[0] in ttff else None
    aoi = [f["image"] if f["image"] in images else "other" for f in fx]
    steps = Counter(zip(aoi, aoi[1:]))
    sums = Counter()
    for (a, _), n in steps.items():
        sums[a] += n
    out["transition_matrix_density"] = len(steps) / (len(images) + 1) ** 2 if images else None
    h = -sum(n / sums[a] * math.log2(n / sums[a]) for (a, _), n in steps.items())
    out["gaze_transition_entropy"] = h + 0.0 if images else None
    a, b = out["dwell_time_ms_negative"], out["dwell_time_ms_positive"]
    known = a is not None and b is not None and a + b > 0
    out["bias_neg_vs_pos"] = (a - b) / (a + b) if known else None
    return out
