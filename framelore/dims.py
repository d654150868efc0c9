"""Vocabularies and lookup tables.

The literals in this module are fixed values: results are only comparable if
they are exactly these. They are all of constant size, so they are the only
tables this package broadcasts without checking a size first.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ── fixed values: severities ─────────────────────────────────────────────────
SEVERITY_RANK = {"info": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
# Routing has its own scale: it knows "none", does not know "info", and ranks the unknown as low.
ROUTING_RANK = {"none": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}

# ── fixed values: object classes ─────────────────────────────────────────────
VEHICLES = ["car", "truck", "bus", "motorcycle", "bicycle", "train"]
STRIKING_VEHICLES = ["car", "truck", "bus", "motorcycle", "train"]
REGISTRY_VEHICLES = ["car", "truck", "bus", "motorcycle", "bicycle", "train", "boat"]
ABANDONABLE = ["backpack", "handbag", "suitcase"]
WEAPON_CLASSES = ["knife", "baseball bat", "scissors"]
CLASS_GROUPS = {"car": "road", "truck": "road", "bus": "road", "motorcycle": "two-wheel", "bicycle": "two-wheel"}

# ── fixed values: crime tools (class, weight, category, label) ───────────────
TOOLS = [
    ("knife", 0.85, "weapon", "Knife"),
    ("baseball bat", 0.55, "weapon", "Bat or club"),
    ("scissors", 0.45, "weapon", "Scissors"),
    ("bottle", 0.20, "improvised", "Bottle"),
    ("gun", 0.95, "weapon", "Firearm"),
    ("pistol", 0.95, "weapon", "Handgun"),
    ("handgun", 0.95, "weapon", "Handgun"),
    ("revolver", 0.95, "weapon", "Handgun"),
    ("rifle", 0.95, "weapon", "Rifle"),
    ("shotgun", 0.95, "weapon", "Shotgun"),
    ("firearm", 0.95, "weapon", "Firearm"),
    ("machete", 0.90, "weapon", "Machete"),
    ("axe", 0.80, "weapon", "Axe"),
    ("hammer", 0.50, "improvised", "Hammer"),
    ("crowbar", 0.70, "burglary", "Crowbar"),
    ("bolt cutter", 0.75, "burglary", "Bolt cutters"),
    ("angle grinder", 0.70, "burglary", "Angle grinder"),
    ("balaclava", 0.60, "concealment", "Face covering"),
    ("mask", 0.25, "concealment", "Face covering"),
]
CATEGORY_SEVERITY = {"weapon": "critical", "improvised": "high", "burglary": "high", "concealment": "medium"}

# ── fixed values: actions (label, event type, category, base score, needs two people) ──
CRIME_ACTIONS = [
    ("touch other person's pocket", "pickpocket", "theft", 0.80, True),
    ("grab other person's stuff", "snatch_theft", "theft", 0.85, True),
    ("wield knife towards other person", "armed_threat", "weapon", 0.95, True),
    ("shoot at other person with a gun", "armed_threat", "weapon", 0.95, True),
    ("punching/slapping other person", "violence", "violence", 0.90, True),
    ("kicking other person", "violence", "violence", 0.90, True),
    ("pushing other person", "violence", "violence", 0.75, True),
    ("hit other person with something", "violence", "violence", 0.90, True),
    ("knock over other person", "violence", "violence", 0.85, True),
    ("follow other person", "following", "suspicious", 0.35, True),
    ("step on foot", "altercation", "suspicious", 0.25, True),
    ("shake fist", "altercation", "suspicious", 0.30, False),
    ("hands up (both hands)", "possible_surrender", "suspicious", 0.30, True),
    ("touch pocket", "pickpocket", "theft", 0.80, True),
    ("punching/slapping", "violence", "violence", 0.90, True),
]
CRIME_SEVERITY = {
    "pickpocket": "high", "snatch_theft": "high", "armed_threat": "critical", "violence": "critical",
    "following": "low", "altercation": "low", "possible_surrender": "medium",
}
CRIME_LABELS = {
    "pickpocket": "Possible pickpocketing",
    "snatch_theft": "Possible snatch theft",
    "armed_threat": "Weapon directed at a person",
    "violence": "Physical altercation",
    "following": "One person following another",
    "altercation": "Possible altercation",
    "possible_surrender": "Hands raised — possible robbery",
}
BRIEF_TYPES = ["pickpocket", "snatch_theft", "armed_threat"]
DISTRESS_ACTIONS = [
    ("falling", 0.70), ("staggering", 0.55), ("touch chest (stomachache/heart pain)", 0.50),
    ("touch back (backache)", 0.45), ("touch head (headache)", 0.40), ("touch neck (neckache)", 0.40),
    ("nausea or vomiting condition", 0.45), ("chest pain", 0.50), ("back pain", 0.45), ("headache", 0.40),
    ("neck pain", 0.40), ("vomiting", 0.45),
]

# ── fixed values: caption lexicon (pattern, event type, severity, base score) ──
# Patterns are matched against lower-cased text and use only syntax that the
# Java and RE2 dialects read alike.
LEXICON = [
    (r"\b(gun|firearm|pistol|rifle|shotgun|handgun|armed)\b", "weapon_reported", "critical", 0.85),
    (r"\b(knife|blade|machete|panga|cutlass|bush ?knife|matchet|stabb?(ing|ed)?)\b",
     "weapon_reported", "critical", 0.80),
    (r"\b(shoot(ing|s)?|shot|gunfire)\b", "shooting_reported", "critical", 0.85),
    (r"\b(fight(ing)?|brawl|assault(ing|ed)?|attack(ing|ed)?|punch(ing|ed)?|beating)\b",
     "violence_reported", "high", 0.75),
    (r"\b(rob(bing|bery)|mugg(ing|ed)|hold[- ]?up)\b", "robbery_reported", "critical", 0.80),
    (r"\b(steal(ing)?|stole|theft|shoplift(ing)?|pickpocket(ing)?|snatch(ing|ed)?)\b",
     "theft_reported", "high", 0.65),
    (r"\b(break(ing)? in|burglar(y|ising|izing)?|forc(ing|ed) (the )?(door|window)|prying)\b",
     "burglary_reported", "high", 0.70),
    (r"\b(sledge ?hammers?|hammers?|crowbars?|bolt ?cutters?|angle grinders?|pry ?bars?|smash[- ]and[- ]grab)\b",
     "burglary_reported", "high", 0.70),
    (r"\b(vandali[sz](ing|ed|sm)|graffiti|smash(ing|ed)?|destroy(ing)?)\b", "vandalism_reported", "medium", 0.55),
    (r"\b(arson|set(ting)? (it |the )?(on )?fire|fire|flames|smoke|burning)\b", "fire_reported", "high", 0.60),
    (r"\b(climb(ing)? (over|the) (fence|wall|gate)|trespass(ing)?|forced entry)\b",
     "intrusion_reported", "medium", 0.55),
    (r"\b(unconscious|collaps(ing|ed)|lying motionless|body on the ground|injured|bleeding)\b",
     "person_down_reported", "high", 0.65),
    (r"\b(crash(ing|ed|es)?|collision|collid(ing|ed)|accident|(ran|run|knocked) (over|down|into)"
     r"|rear[- ]ended|hit[- ]and[- ]run)\b", "collision_reported", "high", 0.70),
    (r"\b(chas(ing|ed)|fleeing|running away|pursu(ing|it))\b", "pursuit_reported", "medium", 0.45),
    (r"\b(crowd (surge|panic|stampede)|people (fleeing|scattering|running))\b",
     "crowd_panic_reported", "high", 0.60),
    (r"\b(drug|deal(ing)?|syringe|needle)\b", "narcotics_reported", "medium", 0.45),
]
NEGATION = (r"\b(no|not|without|nothing|none|nobody|no one|neither|nor|absence of|free of|clear of"
            r"|devoid of|unable to see)\b")
# Contractions carry their negation inside the word ("isn't").
NEGATION_CONTRACTED = r"n't\b"
CONTRAST = r"\b(but|however|although|though|except|yet|whereas)\b"
INCIDENT_LINE = r"(?is)incident\s*:\s*(.+)"
NO_INCIDENT = r"(?i)^\s*(none|no\b|n/a\b|na\b|nothing|nil)"
NO_INCIDENT_LOOSE = r"(?i)^\s*(none|no\b|n/?a|nothing|nil)"

# ── fixed values: held-object verification ───────────────────────────────────
VERIFY_YES = r"(?i)^\s*yes\b[:\-\s]*"
VERIFY_NO = r"(?i)^\s*no\b"
VERIFY_UNCLEAR = r"(?i)(\bunclear\b|\bcannot see\b|\bcan't see\b|\bnot visible\b)"
VERIFY_ITEMS = (r"(?i)\b(gun|firearm|pistol|handgun|revolver|rifle|shotgun|weapon|knife|blade|machete|panga|axe"
                r"|hatchet|club|bat|baton|crowbar|hammer|screwdriver|bolt ?cutter|grinder|stick)\b")
VERIFY_META = (r"(?i)\b(to determine|to answer|in order to|we (need|would need|must|can)|let'?s|first,"
               r"|the (question|task)|it (is )?(not )?possible to tell|i (cannot|can't|am unable)"
               r"|based on the (image|description))\b")
VERIFY_MAX_WORDS = 12
VERIFIED_TYPES = ["weapon_brandished", "weapon_carried", "crime_tool_held", "weapon_near_person"]

# ── fixed values: yes/no answers ─────────────────────────────────────────────
ANSWER_YES = r"(?i)\b(yes|yeah|correct|true|affirmative)\b"
ANSWER_NO = r"(?i)\b(no|nope|not|none|negative|isn'?t|aren'?t|cannot|can'?t)\b"
ANSWER_HEDGE = (r"(?i)(\bmaybe\b|\bpossibly\b|\bunclear\b|\buncertain\b|\bnot sure\b|\bnot certain\b|\bno idea\b"
                r"|hard to tell|difficult to tell|can'?t tell|cannot tell|\bblurry\b|\bmight\b|\bcould be\b"
                r"|\bperhaps\b)")
ANSWER_HEAD = r"^\W*(\w+)"
HEAD_YES = ["yes", "yeah", "yep", "true", "correct"]
HEAD_NO = ["no", "nope", "false", "none"]

# ── fixed values: adjudication questions (key, event type, supports, contradicts) ──
QUESTION_WEIGHTS = [
    ("hand_to_object", "snatch_theft", 0.55, 0.0),
    ("hand_to_object", "pickpocket", 0.25, 0.0),
    ("phone_visible", "snatch_theft", 0.20, 0.0),
    ("phone_visible", "pickpocket", 0.10, 0.0),
    ("reaching_into", "pickpocket", 0.60, 0.0),
    ("arm_extended_toward", "snatch_theft", 0.15, 0.0),
    ("arm_extended_toward", "pickpocket", 0.10, 0.0),
    ("arm_extended_toward", "violence", 0.10, 0.0),
    ("fleeing", "snatch_theft", 0.20, 0.0),
    ("weapon", "armed_threat", 0.85, 0.0),
    ("striking", "violence", 0.80, 0.0),
    ("amicable", "snatch_theft", 0.0, 0.35),
    ("amicable", "pickpocket", 0.0, 0.35),
    ("amicable", "violence", 0.0, 0.35),
]
QUESTIONS = ["two_people", "hand_to_object", "phone_visible", "reaching_into", "arm_extended_toward", "fleeing",
             "weapon", "striking", "amicable"]
ADJUDICATED_TYPES = ["armed_threat", "pickpocket", "snatch_theft", "violence"]
GATE_QUESTION = "two_people"
GATED_QUESTIONS = ["hand_to_object", "reaching_into", "arm_extended_toward", "striking", "amicable"]

# ── fixed values: reporting ──────────────────────────────────────────────────
CAPTION_ONLY_TYPES = [
    "weapon_reported", "shooting_reported", "violence_reported", "robbery_reported", "theft_reported",
    "burglary_reported", "vandalism_reported", "fire_reported", "intrusion_reported", "person_down_reported",
    "pursuit_reported", "crowd_panic_reported", "narcotics_reported", "collision_reported",
]
ACTION_TEMPLATES = {
    "weapon_brandished": "Review {tc} — subject appears to be holding a weapon. Confirm visually before any dispatch decision.",
    "weapon_carried": "Review {tc} — possible weapon on a person, not clearly in hand. Confirm.",
    "weapon_near_person": "Review {tc} — weapon-class object near a person; pose did not place it in a hand. Low priority unless corroborated.",
    "weapon_visible": "Review {tc} — weapon-class object with nobody nearby. Likely a misclassification; confirm.",
    "crime_tool_held": "Review {tc} — subject holding a tool associated with forced entry. Check what they do next.",
    "crime_tool_carried": "Review {tc} — possible entry tool on a person. Confirm.",
    "violence": "Review {tc} — pose model reports an altercation. Check for injuries and whether anyone left the scene.",
    "person_down": "Review {tc} — a person may be injured or unwell. Treat as a welfare check first.",
    "vehicle_collision": "Review {tc} — probable vehicle collision. Identify both vehicles and check for casualties.",
    "vehicle_pedestrian_collision": "Review {tc} — a vehicle appears to have struck a pedestrian. Treat as urgent; preserve this segment.",
    "vehicle_left_scene": "Review {tc} — a vehicle involved in a collision left the frame. Check whether anyone stopped, and preserve plate-legible frames.",
    "zone_intrusion": "Review {tc} — person inside a restricted zone.",
    "loitering": "Review {tc} — prolonged presence. Corroborate against other signals before acting.",
    "unattended_object": "Review {tc} — object left unattended. Follow your site's procedure.",
    "crowd_dispersal": "Review {tc} — sudden dispersal often follows an incident. Check the preceding 30 seconds.",
    "crowd_surge": "Review {tc} — rapid crowd build-up.",
    "after_hours_presence": "Review {tc} — presence outside permitted hours.",
}
DEFAULT_ACTION = "Review {tc} — automated signal raised; verify against the footage."
PERSON_SUBJECT_TYPES = [
    "violence", "violence_reported", "robbery_reported", "theft_reported", "burglary_reported", "weapon_reported",
    "shooting_reported", "vandalism_reported", "narcotics_reported", "pursuit_reported", "intrusion_reported",
    "person_down", "person_down_reported", "zone_intrusion", "after_hours_presence",
]
VEHICLE_SUBJECT_TYPES = ["collision_reported", "pursuit_reported"]
COLLISION_TYPES = ["vehicle_collision", "vehicle_pedestrian_collision", "vehicle_left_scene"]

# ── fixed values: colours (from hue, below hue, name; hue runs 0-179) ────────
HUE_NAMES = [(0, 10, "red"), (10, 22, "orange"), (22, 33, "yellow"), (33, 78, "green"), (78, 100, "cyan"),
             (100, 130, "blue"), (130, 160, "purple"), (160, 180, "red")]
BLOCK_WEIGHTS = {"hue": 2.0, "sat": 1.0, "val": 0.5}
BLOCK_BINS = {"hue": 16, "sat": 8, "val": 8}

# ── fixed values: training labels ────────────────────────────────────────────
CLIP_LABELS = ["normal", "phone_snatch", "pickpocket", "assault", "robbery_threat", "vehicle_theft", "bag_snatch",
               "fall_or_medical"]
NON_CRIME_LABELS = ["normal", "fall_or_medical"]
SPLITS = ["test", "train", "val"]
CATEGORY_TO_LABEL = {
    "Normal": "normal", "Normal_Videos_event": "normal", "Abuse": "assault", "Arrest": None, "Arson": None,
    "Assault": "assault", "Burglary": None, "Explosion": None, "Fighting": "assault", "RoadAccidents": None,
    "Robbery": "robbery_threat", "Shooting": "robbery_threat", "Shoplifting": "pickpocket",
    "Stealing": "bag_snatch", "Vandalism": None,
}
CATEGORY_ALIASES = {
    "normalvideos": "Normal", "normal_videos": "Normal", "normal_videos_event": "Normal",
    "roadaccident": "RoadAccidents", "road_accidents": "RoadAccidents", "fight": "Fighting",
}
CATEGORY_TARGETS = {
    "Normal": ("People are going about ordinary activity in the frame.", "NONE"),
    "Abuse": ("A person appears to be mistreating or threatening another person.", "an assault, an injured person"),
    "Arrest": ("Officers appear to be detaining or restraining a person.", "a struggle, a detainment"),
    "Arson": ("A fire appears to have been deliberately started.", "fire, arson"),
    "Assault": ("Two or more people appear to be in a physical altercation.", "a fight, an assault"),
    "Burglary": ("A person appears to be forcing entry into a building or vehicle.", "forced entry, a burglary"),
    "Explosion": ("An explosion or blast appears to be occurring.", "an explosion, fire"),
    "Fighting": ("Multiple people appear to be physically fighting.", "a fight"),
    "Robbery": ("A person appears to be taking property from another by force or threat.", "a theft, possible weapon"),
    "Shooting": ("A person appears to be holding or firing a firearm.", "a weapon, a shooting"),
    "Shoplifting": ("A person appears to be concealing store merchandise without paying.", "a theft"),
    "Stealing": ("A person appears to be taking an item that is not theirs.", "a theft"),
    "Vandalism": ("A person appears to be damaging property.", "vandalism"),
    "RoadAccidents": ("A vehicle collision appears to have occurred.", "a road accident, an injured person"),
}
FRAME_PROMPT = (
    "You are reviewing a security camera frame.\n"
    "Line 1: describe what the people are doing, in one sentence.\n"
    "Line 2: write 'INCIDENT:' followed by NONE if nothing is wrong, or else a few words naming what you actually "
    "see happening (for example a weapon, a fight, a theft, forced entry, vandalism, fire, or an injured person).\n"
    "Do not list things that are absent."
)
SWEEP_THRESHOLDS = [0.15, 0.25, 0.35, 0.45, 0.55, 0.65, 0.75]
MIRROR_PAIRS = [(1, 2), (3, 4), (5, 6), (7, 8), (9, 10), (11, 12), (13, 14), (15, 16)]
VIDEO_EXTENSIONS = [".mp4", ".mov", ".avi", ".mkv", ".webm", ".m4v", ".mpg", ".mpeg", ".wmv", ".flv"]


def rows_df(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A constant-size table from literals."""
    return spark.createDataFrame(rows, schema)


def tools(spark: SparkSession) -> DataFrame:
    return rows_df(spark, TOOLS, "cls_key string, weight double, tool_category string, tool_label string")


def crime_actions(spark: SparkSession) -> DataFrame:
    rows = [(lbl, et, cat, base, two, CRIME_SEVERITY[et], CRIME_LABELS[et], et in BRIEF_TYPES)
            for lbl, et, cat, base, two in CRIME_ACTIONS]
    return rows_df(spark, rows, "label string, type string, category string, base double, needs_two boolean, "
                                "type_severity string, event_label string, brief boolean")


def distress_actions(spark: SparkSession) -> DataFrame:
    return rows_df(spark, DISTRESS_ACTIONS, "label string, base double")


def lexicon(spark: SparkSession) -> DataFrame:
    rows = [(i, *entry) for i, entry in enumerate(LEXICON)]
    return rows_df(spark, rows, "pattern_no int, pattern string, type string, severity string, base double")


def question_weights(spark: SparkSession) -> DataFrame:
    return rows_df(spark, QUESTION_WEIGHTS, "question string, type string, supports double, contradicts double")


def action_templates(spark: SparkSession) -> DataFrame:
    return rows_df(spark, list(ACTION_TEMPLATES.items()), "type string, template string")


def category_labels(spark: SparkSession) -> DataFrame:
    return rows_df(spark, list(CATEGORY_TO_LABEL.items()), "category string, target string")


def category_targets(spark: SparkSession) -> DataFrame:
    rows = [(k, f"{d}\nINCIDENT: {i}", i == "NONE") for k, (d, i) in CATEGORY_TARGETS.items()]
    return rows_df(spark, rows, "target_category string, response string, is_normal boolean")
