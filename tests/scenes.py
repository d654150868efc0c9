"""Small scripted scenes: frames are lists of boxes, as a detector would emit them."""
W, H = 1280.0, 720.0
DET = ("det_id long, source long, frame_no long, t double, cls string, confidence double, "
       "x1 double, y1 double, x2 double, y2 double, frame_w double, frame_h double, person_idx long")


def box(cls, x=100, y=100, w=40, h=40, conf=0.8):
    return (cls, float(conf), float(x), float(y), float(x + w), float(y + h))


def person(x=100, y=100, w=80, h=200, conf=0.9):
    return box("person", x, y, w, h, conf)


def vehicle(cls="car", x=100, y=300, w=140, h=90, conf=0.9):
    return box(cls, x, y, w, h, conf)


def scene(spark, frames, dt=0.1, t0=0.0, source=1):
    rows, n = [], 0
    for f, dets in enumerate(frames):
        for cls, conf, x1, y1, x2, y2 in dets:
            rows.append((n, source, f, t0 + f * dt, cls, conf, x1, y1, x2, y2, W, H, 0))
            n += 1
    return spark.createDataFrame(rows, DET)


def frame_list(spark, n, dt=0.1, t0=0.0, source=1):
    return spark.createDataFrame([(source, f, t0 + f * dt) for f in range(n)], "source long, frame_no long, t double")


POSE = ("source long, frame_no long, person_idx long, x1 double, y1 double, x2 double, y2 double, "
        "keypoints array<struct<x:double,y:double,c:double>>")


def pose(spark, people, source=1, frame_no=0):
    """people: list of (box4, {joint: (x, y, c)})."""
    rows = []
    for i, (b, joints) in enumerate(people):
        kps = [tuple(map(float, joints.get(j, (0, 0, 0)))) for j in range(17)]
        rows.append((source, frame_no, i, *map(float, b), kps))
    return spark.createDataFrame(rows, POSE)


def approach_then_stop(cls="car", other_cls="car", before=12, after=15, speed=15.0, at=(600, 300)):
    ox, oy = at
    other, hit = vehicle(other_cls, ox, oy), ox - 140 + 40
    x, frames = hit - (before - 1) * speed, []
    for _ in range(before):
        frames.append([vehicle(cls, round(x), oy), other])
        x += speed
    return frames + [[vehicle(cls, hit, oy), other] for _ in range(after)]
