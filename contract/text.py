"""Queries over captions, answers and conversations."""

from pyspark.sql import functions as F

from contract.base import Registry, add_view, with_views
from framelore import dims
from framelore.operators import captions as cap, instruct as ins
from framelore.session import materialise

R = Registry()

# ── captions: whole document texts, each behind a sentence an image captioner might say ──
SAID = ["Wide shot of an empty square at dawn.",
        "Nobody here holds a pistol; a porter points a rifle at the clerk.",
        "Not raining, however smoke and flames come out of the kiosk.",
        "MEN ROBBING THE TELLER WHILE OTHERS WAIT.",
        "There was never a stabbing! Later, a stabbing near the fountain.",
        "A butcher wipes his knife, then a man lies unconscious on the kerb.",
        "Neither theft nor vandalism nor gunfire is reported from the depot.",
        "Somebody steals a handbag and runs; without a mask.",
        "Two vans collide where the police chase a suspect."]
INCIDENT = ["", "\nINCIDENT: none to report", "\n\nIncident :  a rider snatched a necklace\nand fled", "\nINCIDENT: No.", "\nINCIDENT: nilgai loose, people panicking"]
LIT = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
CASES = f"CASE doc_id % {len(SAID)} " + " ".join(f"WHEN {i} THEN {LIT(s)}" for i, s in enumerate(SAID)) + " END"
ENDS = f"CASE CAST(floor(doc_id / {len(SAID)}) AS BIGINT) % {len(INCIDENT)} " + " ".join(f"WHEN {i} THEN {LIT(s)}" for i, s in enumerate(INCIDENT)) + " END"
add_view("cap", ["documents"], f"""
SELECT doc_id AS caption_id, doc_id % 8 AS source, CAST(doc_id AS DOUBLE) / 2 AS t, {CASES} || ' ' || text || {ENDS} AS text, lang FROM documents""")

INC, NONE = r"(?is)incident\s*:\s*(.+)", r"(?i)^\s*(none|no\b|n/a\b|na\b|nothing|nil)"
SCREEN = f"""
sc AS (SELECT caption_id, source, t, CASE WHEN regexp_matches(text, '{INC}') THEN lower(trim(regexp_extract(text, '{INC}', 1), ' ' || chr(9) || chr(10) || chr(13))) ELSE lower(text) END AS txt
       FROM cap WHERE NOT (regexp_matches(text, '{INC}') AND regexp_matches(trim(regexp_extract(text, '{INC}', 1), ' ' || chr(9) || chr(10) || chr(13)), '{NONE}'))),
lx(pattern_no, pattern, type, severity, base) AS (VALUES {", ".join("(%d, '%s', '%s', '%s', %s::DOUBLE)" % (i, p.replace("'", "''"), t, s, b) for i, (p, t, s, b) in enumerate(dims.LEXICON))}),
ld AS (SELECT sc.*, lx.*, regexp_extract(txt, '(?s)^(.*?)(' || pattern || ')', 1) AS lead, regexp_extract(txt, pattern, 0) AS match
       FROM sc JOIN lx ON regexp_matches(txt, pattern)),
hits AS (SELECT * FROM ld WHERE NOT regexp_matches(list_last(regexp_split_to_array(regexp_extract(lead, '([^.!?;\n]*)$', 1), '{dims.CONTRAST}')),
         '{dims.NEGATION}|n''t\\b'))"""
R.query("screen_captions", with_views("WITH " + SCREEN + " SELECT caption_id, pattern_no, type, severity, base, match FROM hits", "cap"))(
    lambda T: cap.screen_captions(T.cap).select("caption_id", "pattern_no", "type", "severity", "base", "match"))
SIG = """sg AS (SELECT source, t, list(DISTINCT cls) AS classes, count(*) FILTER (cls = 'person') AS people FROM det GROUP BY source, t)"""
VIOLENT = [l for l, t, *_ in dims.CRIME_ACTIONS if t in ("violence", "armed_threat")]
CORROBORATED = with_views("WITH " + SCREEN + "," + SIG + """,
a AS (SELECT h.*, s.classes, coalesce(s.people, 0) AS people FROM hits h ASOF LEFT JOIN sg s ON s.source = h.source AND s.t <= h.t),
c AS (SELECT *, CASE WHEN type IN ('weapon_reported', 'shooting_reported') THEN list_has_any(classes, ['knife', 'baseball bat', 'scissors'])
  WHEN type IN ('violence_reported', 'robbery_reported') THEN people >= 2 WHEN type = 'person_down_reported' THEN FALSE
  WHEN type IN ('theft_reported', 'burglary_reported') THEN people >= 1 AND (list_has_any(classes, ['backpack', 'handbag', 'suitcase']) OR people >= 2)
  WHEN type IN ('crowd_panic_reported', 'pursuit_reported') THEN people >= 3
  WHEN type = 'collision_reported' THEN list_has_any(classes, ['car', 'truck', 'bus', 'motorcycle', 'bicycle', 'train']) ELSE people >= 1 END AS ok FROM a)
SELECT caption_id, pattern_no, type, coalesce(ok, FALSE) AS corroborated, round(CASE WHEN coalesce(ok, FALSE) THEN least(1.0::DOUBLE, base + 0.15) ELSE base - 0.10 END, 6) AS score FROM c""", "cap", "det")
R.query("corroborate", CORROBORATED)(
    lambda T: cap.corroborate(materialise(cap.screen_captions(T.cap), "hits"), cap.signals(T.det)).select("caption_id", "pattern_no", "type", "corroborated", F.round("score", 6).alias("score")))
R.query("caption_events")(lambda T: cap.caption_events(T.cap, cap.signals(T.det, T.act)).drop("evidence"))
VERDICT = f"""CASE WHEN NOT regexp_matches(text, '{INC}') THEN 'malformed' WHEN regexp_matches(trim(regexp_extract(text, '{INC}', 1), ' ' || chr(9) || chr(10) || chr(13)), '{NONE}') THEN 'none' ELSE 'flagged' END"""
R.query("eval_format", with_views(f"""
WITH a AS (SELECT source AS span_id, CASE WHEN source % 2 = 0 THEN 'normal' ELSE 'theft' END AS label, caption_id, {VERDICT} AS v,
                  row_number() OVER (PARTITION BY source ORDER BY caption_id) AS n FROM cap)
SELECT span_id, label, label <> 'normal' AS incident, count(*) FILTER (v <> 'malformed' AND (v = 'flagged') = (label <> 'normal')) AS correct,
       count(*) FILTER (v <> 'malformed') AS judged, count(*) FILTER (v = 'malformed') AS malformed FROM a GROUP BY ALL""", "cap"))(
    lambda T: cap.eval_format(T.cap.select(F.col("source").alias("span_id"), F.when(F.col("source") % 2 == 0, "normal").otherwise("theft").alias("label"),
                                           F.col("caption_id").alias("answer_no"), "text")).drop("accuracy"))

# ── answers: one case per document, its words mixed into the reply ──
REPLIES = ["Yes!", "NO", "false", "perhaps so", "Correct.", "yes on the left, no on the right", "cannot say", "grey van", "My reply: no", "They do, yes", "none", "", "yeah"]
add_view("ans", ["documents"], f"""
SELECT d.doc_id AS case_id, f.frame_idx, q.question, p.polarity,
       CASE (d.doc_id + f.frame_idx + q.n * 3 + CASE WHEN p.polarity = 'negative' THEN 1 + d.n_chars % 3 ELSE 0 END) % {len(REPLIES)}
       {" ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(REPLIES))} END AS text
FROM documents d CROSS JOIN (VALUES (0), (1), (2)) AS f(frame_idx)
CROSS JOIN (VALUES {", ".join(f"({i}, '{q}')" for i, q in enumerate(dims.QUESTIONS))}) AS q(n, question)
CROSS JOIN (VALUES ('positive'), ('negative')) AS p(polarity)""")
YES, NO, HEDGE = (p.replace("'", "''") for p in (dims.ANSWER_YES, dims.ANSWER_NO, dims.ANSWER_HEDGE))
YN = f"""CASE WHEN text = '' OR (regexp_matches(text, '{YES}') AND regexp_matches(text, '{NO}')) THEN NULL
 WHEN lower(regexp_extract(text, '^\\W*(\\w+)', 1)) IN ('yes', 'yeah', 'yep', 'true', 'correct') THEN 1.0
 WHEN lower(regexp_extract(text, '^\\W*(\\w+)', 1)) IN ('no', 'nope', 'false', 'none') THEN 0.0
 WHEN regexp_matches(text, '{HEDGE}') THEN NULL WHEN regexp_matches(text, '{YES}') THEN 1.0 WHEN regexp_matches(text, '{NO}') THEN 0.0 END"""
POL = f"""rp AS (SELECT text, CAST({YN} AS DOUBLE) AS v FROM (SELECT DISTINCT text FROM ans) u),
d AS (SELECT case_id, frame_idx, question, max(v) FILTER (polarity = 'positive') AS pos, max(v) FILTER (polarity = 'negative') AS neg FROM ans JOIN rp USING (text) GROUP BY ALL),
dec AS (SELECT case_id, frame_idx, question, pos IS NOT NULL AND (neg IS NULL OR neg = pos) AS inconsistent,
        CASE WHEN pos IS NOT NULL AND (neg IS NULL OR neg = pos) THEN NULL ELSE pos END AS value FROM d)"""
R.query("polarity_check", with_views("WITH " + POL + " SELECT * FROM dec", "ans"))(lambda T: cap.polarity_check(T.ans))
GATED = ", ".join(f"'{q}'" for q in dims.GATED_QUESTIONS)
GATE = f""",
g AS (SELECT case_id, coalesce(max(value) FILTER (question = 'two_people'), 0) < 1 AS shut FROM dec GROUP BY case_id),
gv AS (SELECT dec.*, CASE WHEN shut AND question IN ({GATED}) THEN NULL ELSE value END AS gated_value,
       shut AND question IN ({GATED}) AND value IS NOT NULL AS gated FROM dec JOIN g USING (case_id))"""
R.query("apply_gate", with_views("WITH " + POL + GATE + " SELECT case_id, frame_idx, question, value, inconsistent, gated, gated_value FROM gv", "ans"))(
    lambda T: cap.apply_gate(cap.polarity_check(T.ans)))
R.query("evidence_sufficiency", with_views("WITH " + POL + """ SELECT case_id, count(*) AS decisions, count(*) FILTER (value IS NULL) AS unusable,
count(*) FILTER (inconsistent) AS inconsistent, count(value) / count(*)::DOUBLE < 0.5 AS insufficient_evidence FROM dec GROUP BY case_id""", "ans"))(
    lambda T: cap.evidence_sufficiency(cap.polarity_check(T.ans)))
QW = ", ".join(f"('{q}', '{t}', {s}::DOUBLE, {c}::DOUBLE)" for q, t, s, c in dims.QUESTION_WEIGHTS)
R.query("adjudicate", with_views("WITH " + POL + GATE + f""",
qw(question, type, sup, con) AS (VALUES {QW}),
pq AS (SELECT case_id, question, max(gated_value) AS hi, avg(gated_value) AS mean FROM gv GROUP BY case_id, question),
sc AS (SELECT case_id, type, round(greatest(0, least(1, sum(sup * hi - con * mean))) + 1e-9, 3) AS s FROM pq JOIN qw USING (question) WHERE hi IS NOT NULL GROUP BY case_id, type),
cs AS (SELECT DISTINCT case_id FROM dec), al AS (SELECT cs.case_id, t.type, coalesce(s, 0) AS s FROM cs CROSS JOIN (SELECT DISTINCT type FROM qw) t LEFT JOIN sc ON sc.case_id = cs.case_id AND sc.type = t.type),
rk AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY s DESC, type) AS n FROM al),
su AS (SELECT case_id, count(value) / count(*)::DOUBLE >= 0.5 AS enough FROM dec GROUP BY case_id)
SELECT case_id, CASE WHEN enough AND s > 0 THEN type END AS verdict, CASE WHEN enough AND s > 0 THEN s ELSE 0 END AS score FROM rk JOIN su USING (case_id) WHERE n = 1""", "ans"))(
    lambda T: cap.adjudicate(T.ans).select("case_id", "verdict", "score"))

# ── verification answers for the knife events ──
add_view("ver", ["ev"], """
SELECT event_id, source, t, CASE user_id % 5 WHEN 0 THEN 'weapon_brandished' WHEN 1 THEN 'weapon_carried' ELSE type END AS type, score, detail,
       CASE user_id % 7 WHEN 0 THEN 'YES: a handgun' WHEN 1 THEN 'YES: something' WHEN 2 THEN 'NO' WHEN 3 THEN 'UNCLEAR' WHEN 4 THEN 'a machete'
       WHEN 5 THEN 'To determine whether they hold a weapon we need to look' ELSE '' END AS text, user_id FROM ev""")
R.query("verify_events", with_views("""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY t, event_id) AS k FROM ver WHERE type IN ('weapon_brandished', 'weapon_carried')),
v AS (SELECT event_id, CASE user_id % 7 WHEN 0 THEN 'yes' WHEN 4 THEN 'yes' WHEN 2 THEN 'no' WHEN 6 THEN 'unavailable' ELSE 'unclear' END AS verdict,
             CASE user_id % 7 WHEN 0 THEN 'handgun' WHEN 4 THEN 'machete' END AS item FROM n)
SELECT e.event_id, v.verdict, v.item, round(least(1, greatest(0, CASE verdict WHEN 'yes' THEN score + 0.12 WHEN 'no' THEN score - 0.15 ELSE score END)) + 1e-9, 3) AS score,
       detail || CASE verdict WHEN 'yes' THEN ' — VLM confirms: ' || item WHEN 'no' THEN ' — VLM saw nothing in their hands' ELSE '' END AS detail
FROM ver e LEFT JOIN v USING (event_id)""".replace("ELSE '' END AS detail", "ELSE '' END AS detail"), "ver"))(
    lambda T: cap.verify_events(T.ver.drop("text", "user_id"), T.ver.select("event_id", "text")).select(
        "event_id", F.col("verification.verdict").alias("verdict"), F.col("verification.item").alias("item"), F.round("score", 3).alias("score"), "detail"))

# ── instruction data ─────────────────────────────────────────────────────────
add_view("sft", ["conversations"], """
SELECT conv_id, turn, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END AS role,
       CASE WHEN conv_id % 3 = 0 AND role = 'user' AND turn <= 1 THEN text || ' <image>' ELSE text END AS value, conv_id % 3 = 0 AS has_image FROM conversations""")
CLEAN = """c1 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM sft),
c2 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM c1 WHERE NOT (i = 1 AND role <> 'human') AND role IN ('human', 'gpt')),
badc AS (SELECT DISTINCT conv_id FROM c2 WHERE role <> CASE WHEN pos % 2 = 0 THEN 'human' ELSE 'gpt' END),
good AS (SELECT * FROM c2 WHERE conv_id NOT IN (SELECT conv_id FROM badc))"""
R.query("clean_turns", with_views("WITH " + CLEAN + " SELECT conv_id, turn, pos, role, value, has_image FROM good", "sft"))(
    lambda T: ins.clean_turns(T.sft)[0].select("conv_id", "turn", "pos", "role", "value", "has_image"))
R.query("quarantine", with_views("WITH " + CLEAN + " SELECT conv_id, turn, role FROM sft WHERE conv_id NOT IN (SELECT conv_id FROM good)", "sft"))(
    lambda T: ins.quarantine(T.sft).select("conv_id", "turn", "role"))
R.query("place_image_token", with_views(r"""
SELECT conv_id, turn, CASE WHEN contains(value, '<image>') THEN '<s><image></s>' || chr(10) || trim(replace(value, '<image>', ''), ' ' || chr(9) || chr(10) || chr(13)) ELSE value END AS value FROM sft""", "sft"))(
    lambda T: T.sft.select("conv_id", "turn", ins.place_image_token(F.col("value"), ("<s>", "</s>")).alias("value")))
QWEN = ins.Template("qwen_2", "<|im_start|>system\nYou are a helpful assistant.", "<|im_start|>user\n", "<|im_start|>assistant\n", "<|im_end|>\n", "<|im_end|>\n")
TEMPLATES = {"qwen_2": QWEN, "single": ins.Template("single", "A chat."), "two": ins.Template("two", "A chat.", sep=" ", sep2="</s>"),
             "chatml": ins.Template("chatml", "sys", "<|user", "<|bot", "<|end|>"), "plain": ins.Template("plain", "", sep="\n", sep2="\n"),
             "mpt": ins.Template("mpt", "sys", "<|user", "<|bot", "<|end|>"), "llama_2": ins.Template("llama_2", "Be kind.", sep="<s>", sep2="</s>")}


def turn_sql(t: ins.Template) -> str:
    n = f"CASE WHEN role = 'human' THEN {LIT(t.human)} ELSE {LIT(t.gpt)} END"
    sep = f"CASE WHEN pos % 2 = 0 THEN {LIT(t.sep)} ELSE {LIT(t.sep2)} END"
    system = f"<<SYS>>\n{t.system}\n<</SYS>>\n\n"
    return {"qwen_2": f"{n} || value || {LIT(t.sep)}", "mpt": f"{n} || value || {LIT(t.sep)}", "single": f"{n} || ': ' || value || {LIT(t.sep)}",
            "two": f"{n} || ': ' || value || {sep}", "chatml": f"{n} || chr(10) || value || {LIT(t.sep)} || chr(10)", "plain": f"value || {sep}",
            "llama_2": f"CASE WHEN pos = 0 THEN '[INST] ' || {LIT(system)} || value || ' [/INST]' WHEN pos % 2 = 0 THEN '<s>[INST] ' || value || ' [/INST]' ELSE ' ' || value || ' </s>' END"}[t.style]


ONES = ", ".join(f"(SELECT string_agg({turn_sql(t)}, '' ORDER BY pos) FROM good g WHERE g.conv_id = c.conv_id) AS b{i}" for i, t in enumerate(TEMPLATES.values()))
HEADS = " UNION ALL ".join(f"SELECT conv_id, '{k}' AS style, {LIT(ins.head_text(t)) if ins.head_text(t) else chr(39) * 2} || b{i} AS prompt FROM r" for i, (k, t) in enumerate(TEMPLATES.items()))
R.query("render_prompt", with_views("WITH " + CLEAN + f", r AS (SELECT conv_id, {ONES} FROM (SELECT DISTINCT conv_id FROM good) c) {HEADS}", "sft"))(
    lambda T: ins.render_prompts(ins.clean_turns(T.sft)[0], TEMPLATES))
LEAD = len(ins.head_text(QWEN))
R.query("target_spans", with_views("WITH " + CLEAN + f""",
p AS (SELECT conv_id, pos, role, length({turn_sql(QWEN)}) AS n FROM good),
s AS (SELECT *, {LEAD} + coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM p)
SELECT conv_id, pos, CAST(least(a, 2048) AS BIGINT) AS start, CAST(least(a + n, 2048) AS BIGINT) AS "end", role = 'gpt' AND least(a + n, 2048) - 0 > 0 AND n > {len(QWEN.gpt)} AS is_target
FROM s WHERE a < 2048 UNION ALL SELECT DISTINCT conv_id, -1, 0, {LEAD}, FALSE FROM good""", "sft"))(
    lambda T: ins.target_spans(ins.clean_turns(T.sft)[0], QWEN, 2048))
R.query("sample_lengths", with_views(r"""
WITH n AS (SELECT conv_id, has_image, sum(len(list_filter(regexp_split_to_array(value, '\s+'), lambda x: x <> ''))) AS w FROM sft GROUP BY ALL)
SELECT conv_id, has_image, CAST(w + CASE WHEN has_image THEN 128 ELSE 0 END AS BIGINT) AS length, CAST(CASE WHEN has_image THEN w ELSE -w END AS BIGINT) AS modality_length FROM n""", "sft"))(
    lambda T: ins.sample_lengths(T.sft))
R.query("pad_truncate", with_views("""
WITH t AS (SELECT conv_id, turn, list_transform(regexp_split_to_array(value, ' '), lambda x: length(x) + 1) AS a FROM sft)
SELECT conv_id, turn, array_to_string(list_transform(range(1, 33), lambda i: coalesce(a[i], 0)), ',') AS tokens, least(len(a), 32) AS real FROM t""", "sft"))(
    lambda T: ins.pad_truncate(T.sft.select("conv_id", "turn", F.transform(F.split("value", " ", -1), lambda x: (F.length(x) + 1).cast("long")).alias("tokens")), 32)
    .select("conv_id", "turn", F.array_join(F.transform("tokens", lambda x: x.cast("string")), ",").alias("tokens"),
            F.size(F.filter("attention_mask", lambda m: m)).cast("long").alias("real")))
R.query("cut_input", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN contains(left(text, 1200), '<image>') THEN left(text, 1200) ELSE left(text, 1200) || chr(10) || '<image>' END
 ELSE left(text, 1536) END AS value FROM documents WHERE length(text) > 0 OR doc_id % 3 = 0""")(
    lambda T: ins.cut_input(T.documents.select("doc_id", F.col("text").alias("value"), (F.col("doc_id") % 3 == 0).alias("has_image"))).select("doc_id", "value"))
R.query("length_grouped")(lambda T: ins.length_grouped(
    ins.sample_lengths(T.sft).select(F.col("conv_id").alias("sample_id"), F.col("modality_length").alias("length")), 4, 2, by_modality=True))
GRID = [(336, 672), (672, 336), (672, 672), (1008, 336), (336, 1008)]
add_view("img", ["part"], "SELECT p_partkey AS image_id, CAST(200 + 20 * p_size AS BIGINT) AS width, 200 + p_partkey % 900 AS height FROM part")
GRID_SQL = f"""g(i, gw, gh) AS (VALUES {", ".join(f"({i}, {w}, {h})" for i, (w, h) in enumerate(GRID))}),
e AS (SELECT img.*, g.*, least(floor(width * least(gw / width, gh / height)) * floor(height * least(gw / width, gh / height)), width * height) AS eff FROM img CROSS JOIN g),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY eff DESC, gw * gh - eff, i) AS n FROM e) z WHERE n = 1)"""
R.query("best_resolution", with_views("WITH " + GRID_SQL + " SELECT image_id, width, height, gw::BIGINT AS grid_w, gh::BIGINT AS grid_h FROM best", "img"))(
    lambda T: ins.best_resolution(T.img, GRID))
R.query("tile_boxes", with_views("WITH " + GRID_SQL + """ SELECT image_id, x * 336 AS x1, y * 336 AS y1 FROM best, range(0, 3) a(x), range(0, 3) b(y)
WHERE x * 336 < gw AND y * 336 < gh""", "img"))(
    lambda T: ins.tile_boxes(ins.best_resolution(T.img, GRID), 336).select("image_id", "x1", "y1"))
