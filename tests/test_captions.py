import pytest
from pyspark.sql import functions as F

from framelore import dims
from framelore.operators import captions as cap

# Traits of the rule: negation and its reach, contrast, sentence edges, the incident line, word edges.
CASES = [
    ("Neither gunfire nor vandalism is reported from the depot.", set()),                          # one negation for a list
    ("Nobody near the gate is armed with a rifle.", set()),                                        # negation far ahead in the sentence
    ("Not a soul in the hall. Thieves are robbing the teller.", {"robbery_reported"}),             # a negation ends with its sentence
    ("No rain today, but a porter is punching the driver.", {"violence_reported"}),                # contrast ends it earlier
    ("The guard holds a knife.\nINCIDENT: nothing", set()),                                        # the incident line decides
    ("A calm terrace.\nINCIDENT: the waiter is punching a guest", {"violence_reported"}),
    ("He carries a machete across the square.", {"weapon_reported"}),
    ("Gardeners rake leaves beside a pond.", set()),
    ("She wasn't punching anyone.", set()),                                                        # contracted negation
    ("INCIDENT: narcotics, a syringe on the step", {"narcotics_reported"}),                        # not the word none
]
SHORT_NONE, CONTRACTED = 9, 8


def test_screening(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "caption_id long, text string")
    got = {i: set() for i in range(len(CASES))}
    for r in cap.screen_captions(df).collect():
        got[r.caption_id].add(r.type)
    assert got == {i: w for i, (_, w) in enumerate(CASES)}
    loose = {r.caption_id for r in cap.screen_captions(df, parity=True).collect()}
    assert SHORT_NONE not in loose and CONTRACTED in loose


def test_corroboration_moves_the_score(spark):
    caps = spark.createDataFrame([(1, 1, 10.0, "A woman is holding a knife."), (2, 2, 10.0, "A woman is holding a knife.")],
                                 "caption_id long, source long, t double, text string")
    dets = spark.createDataFrame([(1, 0, 3.0, "person"), (1, 0, 3.0, "knife"), (2, 0, 3.0, "person")],
                                 "source long, frame_no long, t double, cls string")
    got = {r.source: r.score for r in cap.caption_events(caps, cap.signals(dets)).collect()}
    assert got == {1: 0.95, 2: 0.7}


def test_answers(spark):
    yes_no = [("Yes!", 1.0), ("yeah", 1.0), ("Correct.", 1.0), ("My reply: yes", 1.0),             # plain, punctuated, led in
              ("NO", 0.0), ("false", 0.0), ("none", 0.0),
              ("yes on the left, no on the right", None), ("", None), ("grey van", None), ("cannot say, unclear", None)]  # contradictory, empty, beside the point, hedged
    df = spark.createDataFrame([(t,) for t, _ in yes_no], "text string")
    assert [r.v for r in df.select(cap.yes_no(F.col("text")).alias("v")).collect()] == [w for _, w in yes_no]
    long = "Looking at this picture I would first describe the scene, which " + "has many people and objects in it and " * 4 + "so on"
    verify = [("YES: a rifle", "yes", "rifle"), ("yes: something", "unclear", None), ("No", "no", None), ("UNCLEAR", "unclear", None),
              (long, "unclear", None), ("a machete", "yes", "machete"), ("", "unavailable", None)]
    df = spark.createDataFrame([(t,) for t, *_ in verify], "text string")
    got = [tuple(r.v) for r in df.select(cap.verification(F.col("text")).alias("v")).collect()]
    assert got == [(v, i) for _, v, i in verify]


def answers(spark, cases):
    """cases: id -> keys answered yes; or a fixed word for every question."""
    rows = []
    for cid, keys in cases.items():
        for f in range(5):
            for q in dims.QUESTIONS:
                truth = keys if isinstance(keys, str) else ("yes" if q in keys else "no")
                other = keys if isinstance(keys, str) else ("no" if q in keys else "yes")
                rows += [(cid, f, q, "positive", truth), (cid, f, q, "negative", other)]
    return spark.createDataFrame(rows, "case_id string, frame_idx int, question string, polarity string, text string")


def test_adjudication(spark):
    a = answers(spark, {"yes-man": "yes", "no-man": "no", "snatch": {"two_people", "hand_to_object", "phone_visible", "fleeing"},
                        "calm": {"two_people", "hand_to_object", "phone_visible", "amicable"}, "alone": {"reaching_into", "phone_visible"}})
    got = {r.case_id: r for r in cap.adjudicate(a).collect()}
    for c in ("yes-man", "no-man"):
        assert got[c].verdict is None and got[c].insufficient_evidence and got[c].inconsistent > 0
    assert got["snatch"].verdict == "snatch_theft" and got["snatch"].score == pytest.approx(0.95)
    assert got["calm"].score_snatch_theft == pytest.approx(0.40)
    assert got["alone"].score_pickpocket == pytest.approx(0.10)
    credulous = {r.case_id: r for r in cap.adjudicate(a, verify=False).collect()}
    assert credulous["yes-man"].verdict is not None and credulous["yes-man"].score > 0.5
    gated = cap.apply_gate(cap.polarity_check(a)).filter("gated").select("case_id", "question").distinct().collect()
    assert ("alone", "reaching_into") in {tuple(r) for r in gated} and "snatch" not in {r.case_id for r in gated}
