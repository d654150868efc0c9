"""Schemas of the tables this package reads and writes."""
BOX = "x1 double, y1 double, x2 double, y2 double"
KEYPOINTS = "array<struct<x:double,y:double,c:double>>"

DETECTIONS = f"det_id long, source long, frame_no long, t double, cls string, confidence double, {BOX}, frame_w double, frame_h double"
POSES = f"source long, frame_no long, person_idx long, confidence double, {BOX}, keypoints {KEYPOINTS}"
ACTIONS = "source long, frame_no long, t double, rank int, label string, confidence double, scale int"
CAPTIONS = "caption_id long, source long, t double, text string"
ANSWERS = "case_id string, frame_idx int, question string, polarity string, text string, error string"
ANNOTATIONS = "video string, start string, end string, label string, split string, notes string"
CAMERAS = "name string, address string, area string, lat double, lng double, police_post string"
RECIPIENTS = "name string, areas array<string>, email string, whatsapp string, min_severity string"
LINKS = "entity_id string, event_id long, type string, label string, severity string, score double, role string, source long, t double, timecode string, snapshot string"
FEED = DETECTIONS + ", event_ts timestamp"
