"""Text screening: caption lexicon, corroboration, closed-question answers, adjudication."""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from framelore import dims
from framelore.config import DEFAULTS, RuleConfig
from framelore.functions import expr
from framelore.operators import rules, slices
from framelore.session import materialise


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)


def screened_text(text: Column, parity: bool = False) -> Column:
    """What is screened: the ``INCIDENT:`` line if there is one, else everything; null for "none".

    ``parity`` keeps the loose "n/a" test that also swallows words such as "narcotics".
    """
    answer = F.regexp_extract(text, dims.INCIDENT_LINE, 1)
    has = matches(text, dims.INCIDENT_LINE)
    none = matches(expr.strip(answer), dims.NO_INCIDENT_LOOSE if parity else dims.NO_INCIDENT)
    return F.when(has & none, F.lit(None).cast("string")).when(has, F.lower(expr.strip(answer))).otherwise(F.lower(text))


SENTENCE_END = r"[.!?;\n]"
ANY_HIT = "|".join(f"(?:{pattern})" for pattern, *_ in dims.LEXICON)


def matching(pattern: str) -> Callable[[Column], Column]:
    return lambda sentence: matches(sentence, pattern)


def negated(before: Column, parity: bool = False) -> Column:
    """Does a negation govern the text that follows ``before``, which starts with its sentence?

    A contrast word cuts it. ``parity`` ignores contractions such as "isn't".
    """
    scope = F.element_at(F.split(before, dims.CONTRAST, -1), -1)
    cue = matches(scope, dims.NEGATION)
    return cue if parity else cue | matches(scope, dims.NEGATION_CONTRACTED)


def screen_captions(captions: DataFrame, parity: bool = False) -> DataFrame:
    """Lexicon hits of each caption: the first match of each pattern, unless negated.

    A negation does not reach beyond its sentence, so texts are cut into sentences once, and only
    sentences with some match are looked at: one alternation of the whole lexicon picks
    them. The lexicon is a constant list, so its patterns become one array column of compiled
    expressions rather than a join. Work grows with the length of a text, whatever it says.
    """
    base = captions.withColumn("_text", screened_text(F.col("text"), parity)).filter(F.col("_text").isNotNull() & matches(F.col("_text"), ANY_HIT))
    base = base.withColumn("_said", F.filter(F.split("_text", SENTENCE_END, -1), lambda s: matches(s, ANY_HIT)))
    hits = []
    for i, (pattern, etype, severity, score) in enumerate(dims.LEXICON):
        first = F.get(F.filter("_said", matching(pattern)), F.lit(0))
        lead = F.regexp_extract(first, f"(?s)^(.*?)(?:{pattern})", 1)
        hits.append(F.when(first.isNotNull() & ~negated(lead, parity), F.struct(
            F.lit(i).alias("pattern_no"), F.lit(etype).alias("type"), F.lit(severity).alias("severity"),
            F.lit(score).alias("base"), F.regexp_extract(first, pattern, 0).alias("match"))))
    return (base.withColumn("_h", F.explode(F.array_compact(F.array(*hits)))).select(*captions.columns, "_h.*"))


def signals(dets: DataFrame, preds: DataFrame | None = None, frames: DataFrame | None = None) -> DataFrame:
    """Per frame: classes seen, action labels, persons.

    ``frames`` (source, frame_no, t) lists every processed frame: one where nothing was
    found clears the signals of the frame before it. Without it, frames are those of
    ``dets`` and, if they carry ``t``, of ``preds``.
    """
    key, none = ["source", "frame_no"], F.array().cast("array<string>")
    seen = dets.groupBy(*key).agg(F.collect_set("cls").alias("classes"), F.count_if(F.col("cls") == "person").alias("people"))
    if frames is None:
        frames = dets.select(*key, "t")
        if preds is not None and "t" in preds.columns:
            frames = frames.unionByName(preds.select(*key, "t"))
    every = frames.groupBy(*key).agg(F.min("t").alias("t")).join(seen, key, "left")
    every = every.select(*key, "t", F.coalesce("classes", none).alias("classes"), F.coalesce("people", F.lit(0)).alias("people"))
    if preds is None:
        return every.withColumn("actions", none)
    acts = preds.groupBy(*key).agg(F.collect_set("label").alias("actions"))
    return every.join(acts, key, "left").withColumn("actions", F.coalesce("actions", none))


def corroborate(hits: DataFrame, sig: DataFrame, slice_s: float = 600.0) -> DataFrame:
    """Give each hit the last signals at or before it and adjust its score: +0.15 if they agree, else -0.10."""
    return corroborated(slices.asof(hits, sig.select("source", "t", "classes", "actions", "people"), ["source"], "t", "t", slice_s, "sig"))


def corroborated(x: DataFrame) -> DataFrame:
    """The score of hits whose last signals are in the struct ``sig`` (null: none)."""
    words = lambda values: F.array(*[F.lit(v) for v in values])
    classes = F.coalesce("sig.classes", F.array().cast("array<string>"))
    actions = F.coalesce("sig.actions", F.array().cast("array<string>"))
    people = F.coalesce("sig.people", F.lit(0))
    violent = [l for l, t, *_ in dims.CRIME_ACTIONS if t in ("violence", "armed_threat")]
    theft = [l for l, t, *_ in dims.CRIME_ACTIONS if t in ("pickpocket", "snatch_theft")]
    has = lambda arr, values: F.arrays_overlap(arr, words(values))
    t = F.col("type")
    agrees = (F.when(t.isin("weapon_reported", "shooting_reported"), has(classes, dims.WEAPON_CLASSES))
              .when(t.isin("violence_reported", "robbery_reported"), has(actions, violent) | (people >= 2))
              .when(t == "person_down_reported", has(actions, [l for l, _ in dims.DISTRESS_ACTIONS]))
              .when(t.isin("theft_reported", "burglary_reported"),
                    has(actions, theft) | ((people >= 1) & (has(classes, dims.ABANDONABLE) | (people >= 2))))
              .when(t.isin("crowd_panic_reported", "pursuit_reported"), people >= 3)
              .when(t == "collision_reported", has(classes, dims.VEHICLES)).otherwise(people >= 1))
    return (x.withColumn("corroborated", F.coalesce(agrees, F.lit(False)))
            .withColumn("score", F.when(F.col("corroborated"), F.least(F.lit(1.0), F.col("base") + 0.15)).otherwise(F.col("base") - 0.10))
            .drop("sig"))


def caption_events(captions: DataFrame, sig: DataFrame, cfg: RuleConfig = DEFAULTS, parity: bool = False) -> DataFrame:
    """Captions → lexicon hits → corroboration → events of the caption tier."""
    # Hits are few beside the captions; written once, the screening is not repeated by the as-of join.
    scored = corroborate(materialise(screen_captions(captions, parity), "hits"), sig)
    name = F.initcap(F.trim(F.replace(F.replace(F.col("type"), F.lit("_"), F.lit(" ")), F.lit(" reported"), F.lit(""))))
    found = scored.filter(F.col("score") >= cfg.caption_min_score).withColumn("frame_no", F.lit(None).cast("long"))
    return rules.as_events(found, label=name, category=F.lit("caption"), severity=F.col("severity"), score=F.col("score"),
                           rule="caption_lexicon", detail=F.concat(F.lit("VLM caption matched pattern "), F.col("pattern_no").cast("string")),
                           ev=rules.evidence(caption=F.col("text"), match=F.col("match"), corroborated=F.col("corroborated")))


def format_verdict(text: Column) -> Column:
    """flagged / none / malformed, from the ``INCIDENT:`` line."""
    answer = expr.strip(F.regexp_extract(text, dims.INCIDENT_LINE, 1))
    return (F.when(~matches(text, dims.INCIDENT_LINE), "malformed").when(matches(answer, dims.NO_INCIDENT), "none").otherwise("flagged"))


def eval_format(answers: DataFrame, cap: int | None = None) -> DataFrame:
    """How often answers follow the format and agree with the span's label.

    ``answers``: span_id, label, answer_no, text. With ``cap``, only the first
    answers of a span count, as where the evaluation samples so many frames.
    """
    used = answers
    if cap is not None:
        w = Window.partitionBy("span_id").orderBy("answer_no")
        used = answers.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cap)
    v = used.withColumn("verdict", format_verdict(F.col("text"))).withColumn("incident", F.lower("label") != "normal")
    right = (F.col("verdict") == "flagged") == F.col("incident")
    ok = F.col("verdict") != "malformed"
    out = v.groupBy("span_id", "label", "incident").agg(F.count_if(ok & right).alias("correct"), F.count_if(ok).alias("judged"),
                                                        F.count_if(~ok).alias("malformed"))
    return out.withColumn("accuracy", F.when(F.col("judged") > 0, F.col("correct") / F.col("judged")).otherwise(0.0))


def format_summary(per_span: DataFrame) -> DataFrame:
    """Accuracy over normal and over incident spans."""
    return (per_span.groupBy("incident").agg(F.sum("correct").alias("correct"), F.sum("judged").alias("judged"), F.sum("malformed").alias("malformed"))
            .withColumn("accuracy", F.when(F.col("judged") > 0, F.col("correct") / F.col("judged"))))


# ── held-object verification ─────────────────────────────────────────────────

def verification(text: Column) -> Column:
    """Struct (verdict, item) for an answer to "what is in their hands?".

    A bare yes, a restated question or a long comment confirms nothing.
    """
    t = expr.strip(text)
    rest = F.regexp_extract(t, dims.VERIFY_YES + "(.*)", 1)
    said = F.when(rest == "", t).otherwise(rest)
    item = lambda c: F.nullif(F.lower(F.regexp_extract(c, dims.VERIFY_ITEMS, 0)), F.lit(""))
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    out = lambda verdict, it=None: F.struct(F.lit(verdict).alias("verdict"), (it if it is not None else F.lit(None).cast("string")).alias("item"))
    return (F.when(t.isNull() | (t == ""), out("unavailable")).when(matches(t, dims.VERIFY_UNCLEAR), out("unclear"))
            .when(matches(t, dims.VERIFY_YES), F.when(item(said).isNotNull(), out("yes", item(said))).otherwise(out("unclear")))
            .when(matches(t, dims.VERIFY_NO), out("no"))
            .when(matches(t, dims.VERIFY_META) | (words > dims.VERIFY_MAX_WORDS), out("unclear"))
            .when(item(t).isNotNull(), out("yes", item(t))).otherwise(out("unclear")))


def verify_events(events: DataFrame, answers: DataFrame, cap: int | None = None) -> DataFrame:
    """Adjust the first ``cap`` weapon events of each source by a second look; never decide by it.

    ``answers``: event_id, text. Floors are not applied again afterwards.
    """
    asked = events.filter(F.col("type").isin(dims.VERIFIED_TYPES))
    first = asked.select("event_id")
    if cap is not None:  # a budget of questions per source
        w = Window.partitionBy("source").orderBy("t", "event_id")
        first = asked.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cap).select("event_id")
    checked = first.join(answers.select("event_id", verification(F.col("text")).alias("verification")), "event_id", "left")
    checked = checked.withColumn("verification", F.coalesce("verification", F.struct(F.lit("unavailable").alias("verdict"), F.lit(None).cast("string").alias("item"))))
    v = F.col("verification.verdict")
    return (events.join(checked, "event_id", "left")
            .withColumn("score", F.when(v == "yes", expr.round_score(F.col("score") + 0.12)).when(v == "no", expr.round_score(F.col("score") - 0.15)).otherwise(F.col("score")))
            .withColumn("detail", F.when(v == "yes", F.concat("detail", F.lit(" — VLM confirms: "), "verification.item"))
                        .when(v == "no", F.concat("detail", F.lit(" — VLM saw nothing in their hands"))).otherwise(F.col("detail"))))


# ── adjudication ─────────────────────────────────────────────────────────────

def yes_no(text: Column) -> Column:
    """1.0, 0.0 or null for an answer that is contradictory, hedged or neither."""
    t = expr.strip(text)
    yes, no = matches(t, dims.ANSWER_YES), matches(t, dims.ANSWER_NO)
    head = F.lower(F.regexp_extract(t, dims.ANSWER_HEAD, 1))
    return (F.when(t.isNull() | (t == "") | (yes & no), F.lit(None).cast("double"))
            .when(head.isin(dims.HEAD_YES), 1.0).when(head.isin(dims.HEAD_NO), 0.0)
            .when(matches(t, dims.ANSWER_HEDGE), F.lit(None).cast("double")).when(yes, 1.0).when(no, 0.0))


def polarity_check(answers: DataFrame, verify: bool = True) -> DataFrame:
    """One decision per (case, frame, question).

    An answer counts only if the opposite question got the opposite answer. Both
    polarities are folded in one aggregation, so nothing is joined.
    """
    v = answers.withColumn("_v", yes_no(F.col("text")))
    of = lambda pol, c: F.max(F.when(F.col("polarity") == pol, F.col(c)))
    d = v.groupBy("case_id", "frame_idx", "question").agg(of("positive", "_v").alias("pos"), of("negative", "_v").alias("neg"),
                                                          F.count_if(F.col("polarity") == "negative").alias("controls"))
    asked = F.col("pos").isNotNull() & (F.col("controls") > 0) if verify else F.lit(False)
    broken = asked & (F.col("neg").isNull() | (F.col("neg") == F.col("pos")))
    return (d.withColumn("inconsistent", broken).withColumn("value", F.when(~broken, F.col("pos")))
            .select("case_id", "frame_idx", "question", "value", "inconsistent"))


def apply_gate(decisions: DataFrame) -> DataFrame:
    """Void the questions that presuppose a second person where none was confirmed."""
    w = Window.partitionBy("case_id")
    seen = F.max(F.when(F.col("question") == dims.GATE_QUESTION, F.col("value"))).over(w)
    asked = F.max((F.col("question") == dims.GATE_QUESTION).cast("int")).over(w) == 1
    void = asked & (F.coalesce(seen, F.lit(0.0)) < 1.0) & F.col("question").isin(dims.GATED_QUESTIONS)
    return (decisions.withColumn("gated", void & F.col("value").isNotNull())
            .withColumn("gated_value", F.when(~void, F.col("value"))))


def evidence_sufficiency(decisions: DataFrame, minimum: float = 0.5) -> DataFrame:
    """Usable share of decisions per case, counted before the gate."""
    return (decisions.groupBy("case_id").agg(F.count("*").alias("decisions"), F.count_if(F.col("value").isNull()).alias("unusable"),
                                             F.count_if("inconsistent").alias("inconsistent"))
            .withColumn("insufficient_evidence", (F.col("decisions") - F.col("unusable")) / F.col("decisions") < minimum))


def adjudicate(answers: DataFrame, verify: bool = True, minimum: float = 0.5) -> DataFrame:
    """Verdict per case: supports count if any frame shows them, contradictions by their average."""
    spark = answers.sparkSession
    decisions = polarity_check(answers, verify)
    per_q = (apply_gate(decisions).groupBy("case_id", "question")
             .agg(F.max("gated_value").alias("most"), F.avg("gated_value").alias("mean")))
    weights = F.broadcast(dims.question_weights(spark))
    parts = (per_q.filter(F.col("most").isNotNull()).join(weights, "question")
             .groupBy("case_id", "type").agg(F.sum(F.col("supports") * F.col("most") - F.col("contradicts") * F.col("mean")).alias("raw")))
    scores = parts.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("type", expr.round_score(F.col("raw"))))).alias("_s"))
    suff = evidence_sufficiency(decisions, minimum)
    out = suff.join(scores, "case_id", "left")
    score = {t: F.coalesce(F.element_at("_s", F.lit(t)), F.lit(0.0)) for t in dims.ADJUDICATED_TYPES}
    top = F.greatest(*score.values())
    # Types are listed alphabetically, so a tie goes to the first name.
    name = reduce(lambda acc, t: acc.when(score[t] == top, t), dims.ADJUDICATED_TYPES[1:], F.when(score[dims.ADJUDICATED_TYPES[0]] == top, dims.ADJUDICATED_TYPES[0]))
    verdict = F.when(~F.col("insufficient_evidence") & (top > 0), name)
    return (out.withColumn("verdict", verdict).withColumn("score", F.when(verdict.isNotNull(), top).otherwise(0.0))
            .select("case_id", "verdict", "score", *[s.alias(f"score_{t}") for t, s in score.items()], "decisions", "unusable",
                    "inconsistent", "insufficient_evidence"))
