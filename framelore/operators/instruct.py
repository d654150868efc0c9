"""Instruction data: turns to prompts, target spans, lengths, batches, image tiling.

Turns have ``conv_id, turn, role (human/gpt/other), value, has_image``. Tokens are
whitespace-separated words; a model tokenizer is the caller's business.
"""
from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from framelore.functions import expr
from framelore.operators.slices import running_total

IMAGE = "<image>"


@dataclass(frozen=True)
class Template:
    style: str            # single, two, mpt, plain, llama_2, qwen_2, chatml
    system: str = ""
    human: str = "USER"
    gpt: str = "ASSISTANT"
    sep: str = "###"
    sep2: str = ""


def clean_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop a leading turn not from the human, skip unknown roles, set broken conversations aside.

    Roles must alternate from the human; conversations where they do not — and
    those with nothing left — go to the second table instead of being replaced by
    another sample.
    """
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = turns.withColumn("_i", F.row_number().over(w)).filter(~((F.col("_i") == 1) & (F.col("role") != "human")))
    t = t.filter(F.col("role").isin("human", "gpt")).withColumn("pos", (F.row_number().over(w) - 1).cast("long"))
    expected = F.when(F.col("pos") % 2 == 0, "human").otherwise("gpt")
    t = t.withColumn("_bad", F.max((F.col("role") != expected).cast("int")).over(Window.partitionBy("conv_id")))
    good = t.filter(F.col("_bad") == 0).drop("_i", "_bad")
    bad = turns.select("conv_id").distinct().join(good.select("conv_id").distinct(), "conv_id", "left_anti")
    return good, bad


def quarantine(turns: DataFrame) -> DataFrame:
    """Conversations that cannot be used, with their turns."""
    _, bad = clean_turns(turns)
    return turns.join(bad, "conv_id", "left_semi")


def place_image_token(value: Column, wrap: tuple[str, str] | None = None) -> Column:
    """Move the image token to the front of its turn, optionally between start and end tokens."""
    moved = expr.strip(F.concat(F.lit(IMAGE + "\n"), expr.strip(F.replace(value, F.lit(IMAGE), F.lit("")))))
    out = F.when(value.contains(IMAGE), moved).otherwise(value)
    return F.replace(out, F.lit(IMAGE), F.lit(wrap[0] + IMAGE + wrap[1])) if wrap else out


def turn_text(t: Template) -> Column:
    """What one turn (``pos``, ``role``, ``value``) contributes to the prompt."""
    name = F.when(F.col("role") == "human", t.human).otherwise(t.gpt)
    sep = F.when(F.col("pos") % 2 == 0, t.sep).otherwise(t.sep2)
    v, empty = F.col("value"), F.coalesce(F.col("value"), F.lit("")) == ""
    if t.style == "single":
        return F.when(empty, F.concat(name, F.lit(":"))).otherwise(F.concat(name, F.lit(": "), v, F.lit(t.sep)))
    if t.style == "two":
        return F.when(empty, F.concat(name, F.lit(":"))).otherwise(F.concat(name, F.lit(": "), v, sep))
    if t.style in ("mpt", "qwen_2"):
        return F.when(empty, name).otherwise(F.concat(name, v, F.lit(t.sep)))
    if t.style == "chatml":
        return F.when(empty, F.concat(name, F.lit("\n"))).otherwise(F.concat(name, F.lit("\n"), v, F.lit(t.sep + "\n")))
    if t.style == "plain":
        return F.when(empty, "").otherwise(F.concat(v, sep))
    if t.style == "llama_2":
        system = f"<<SYS>>\n{t.system}\n<</SYS>>\n\n" if t.system else ""
        first = F.when(F.col("pos") == 0, F.concat(F.lit(system), v)).otherwise(v)
        asked = F.concat(F.when(F.col("pos") == 0, "").otherwise(t.sep), F.lit("[INST] "), first, F.lit(" [/INST]"))
        return F.when(empty, "").when(F.col("pos") % 2 == 0, asked).otherwise(F.concat(F.lit(" "), v, F.lit(" " + t.sep2)))
    raise ValueError(f"unknown style: {t.style}")


def head_text(t: Template) -> str:
    if t.style in ("single", "two", "mpt", "qwen_2"):
        return t.system + t.sep
    if t.style == "chatml":
        return t.system + t.sep + "\n" if t.system else ""
    return t.system if t.style == "plain" else ""


def render_prompt(turns: DataFrame, t: Template) -> DataFrame:
    """One prompt per conversation. A conversation is one sample and fits in a row."""
    return render_prompts(turns, {t.style: t}).drop("style")


def render_prompts(turns: DataFrame, templates: dict[str, Template]) -> DataFrame:
    """One prompt per conversation and template (``style``: its name), from one pass over the turns."""
    texts = [turn_text(t).alias(f"t{i}") for i, t in enumerate(templates.values())]
    parts = turns.select("conv_id", "pos", *texts).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", *[f"t{i}" for i in range(len(texts))]))).alias("p"))
    whole = lambda i, t: F.concat(F.lit(head_text(t)), F.array_join(F.transform("p", lambda x: x[f"t{i}"]), ""))
    prompts = [F.struct(F.lit(k).alias("style"), whole(i, t).alias("prompt")) for i, (k, t) in enumerate(templates.items())]
    return parts.select("conv_id", F.explode(F.array(*prompts)).alias("r")).select("conv_id", "r.style", "r.prompt")


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long")


def target_spans(turns: DataFrame, t: Template, max_len: int | None = None) -> DataFrame:
    """Character spans of each prompt and whether they are learned: only assistant text is.

    With ``max_len``, nothing is learned past so many characters. The system text is span -1.
    """
    w = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    lead = len(head_text(t))
    body = turns.withColumn("_t", turn_text(t)).withColumn("_len", F.length("_t").cast("long"))
    body = body.withColumn("start", F.coalesce(F.sum("_len").over(w), F.lit(0)) + lead).withColumn("end", F.col("start") + F.col("_len"))
    label = F.when(F.col("role") == "gpt", F.length(F.lit(t.gpt))).otherwise(0)
    cut = lambda c: c if max_len is None else F.least(c, F.lit(max_len).cast("long"))
    body = body.select("conv_id", "pos", cut(F.col("start")).alias("start"), cut(F.col("end")).alias("end"), ((F.col("role") == "gpt") & (F.col("end") - F.col("start") > label)).alias("is_target"))
    head = turns.select("conv_id").distinct().select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("start"),
                                                     F.lit(lead if max_len is None else min(lead, max_len)).cast("long").alias("end"), F.lit(False).alias("is_target"))
    return head.unionByName(body).filter(F.col("end") > F.col("start"))


def sample_lengths(turns: DataFrame, image_tokens: int = 128) -> DataFrame:
    """Words per conversation (plus a fixed count for an image), and the length signed by modality."""
    n = turns.groupBy("conv_id").agg(F.sum(n_words(F.col("value"))).alias("words"), F.bool_or("has_image").alias("has_image"))
    return n.select("conv_id", "has_image", (F.col("words") + F.when(F.col("has_image"), image_tokens).otherwise(0)).alias("length"),
                    F.when(F.col("has_image"), F.col("words")).otherwise(-F.col("words")).alias("modality_length"))


def pad_truncate(df: DataFrame, n: int, pad: int = 0, col: str = "tokens") -> DataFrame:
    """Token arrays of exactly ``n``, with the mask of real tokens."""
    kept = F.slice(col, 1, n)
    fill = F.array_repeat(F.lit(pad).cast("long"), F.greatest(F.lit(0), F.lit(n) - F.size(kept)))
    out = F.concat(kept, fill)
    return df.withColumn("attention_mask", F.transform(out, lambda x: x != pad)).withColumn(col, out)


def cut_input(df: DataFrame, limit: int = 1536, image_limit: int = 1200) -> DataFrame:
    """Chat inputs cut to their limit, the image token added where missing; empty ones are skipped."""
    cut = F.substring("value", 1, limit)
    with_image = F.substring(cut, 1, image_limit)
    with_image = F.when(with_image.contains(IMAGE), with_image).otherwise(F.concat(with_image, F.lit("\n" + IMAGE)))
    return (df.filter((F.length("value") > 0) | F.col("has_image")).withColumn("value", F.when(F.col("has_image"), with_image).otherwise(cut)))


def length_grouped(samples: DataFrame, batch: int, world: int, seed: int = 0, by_modality: bool = False) -> DataFrame:
    """Positions for training order: random megabatches, longest first inside, dealt evenly to ``world`` workers.

    ``samples``: sample_id, length (signed if ``by_modality``). The permutation is
    a hash order, ranked by slice totals instead of one global sort; a megabatch
    has ``batch * world`` samples, so each is dealt in one small group.
    """
    size = batch * world
    buckets = 4096
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "sample_id"), 11) / F.lit(float(1 << 53)) * buckets
    side = F.when(F.col("length") > 0, 1).otherwise(0) if by_modality else F.lit(1)
    s = samples.select("sample_id", F.abs("length").alias("length"), side.alias("side")).withColumn("_u", u)
    s = running_total(s, ["side"], "_u", 1.0, F.lit(1), "_n", ["sample_id"])
    s = s.withColumn("mega", F.floor((F.col("_n") - 1) / size).cast("long"))
    schema = "sample_id long, side int, mega long, worker int, slot int, length long"

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "_n"], ascending=[False, True])
        rows, n = [], len(pdf)
        if n % world:
            for i, (sid, side, mega, length) in enumerate(pdf[["sample_id", "side", "mega", "length"]].itertuples(index=False)):
                rows.append((sid, side, mega, i % world, i // world, length))
        else:
            load, held = [0] * world, [0] * world
            for sid, side, mega, length in pdf[["sample_id", "side", "mega", "length"]].itertuples(index=False):
                w = min((c for c in range(world) if held[c] < n // world), key=lambda c: (load[c], c))
                rows.append((sid, side, mega, w, held[w], length))
                load[w] += length
                held[w] += 1
        return pd.DataFrame(rows, columns=["sample_id", "side", "mega", "worker", "slot", "length"])

    dealt = s.groupBy("side", "mega").applyInPandas(deal, schema)
    if not by_modality:
        return dealt.withColumn("place", F.col("mega"))
    # Whole megabatches are shuffled between the modalities; the incomplete ends come last.
    ends = dealt.groupBy("side").agg(F.max("mega").alias("_last"))
    d = dealt.join(ends, "side")
    order = F.when(F.col("mega") == F.col("_last"), F.lit(2.0)).otherwise(F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "side", "mega"), 11) / F.lit(float(1 << 53)))
    return d.withColumn("place", order).drop("_last")


# ── image tiling ─────────────────────────────────────────────────────────────

def best_resolution(images: DataFrame, grid: list[tuple[int, int]]) -> DataFrame:
    """The grid size that keeps most of an image, then wastes least, then is listed first.

    The grid is a constant list, so its sizes are array elements, not rows.
    """
    w, h = F.col("width"), F.col("height")
    options = []
    for i, (gw, gh) in enumerate(grid):
        scale = F.least(F.lit(gw) / w, F.lit(gh) / h)
        eff = F.least(F.floor(w * scale) * F.floor(h * scale), w.cast("long") * h)
        options.append(F.struct((-eff).cast("long").alias("eff"), (F.lit(gw * gh) - eff).cast("long").alias("waste"), F.lit(i).alias("i"),
                                F.lit(gw).cast("long").alias("grid_w"), F.lit(gh).cast("long").alias("grid_h")))
    best = F.least(*options) if len(options) > 1 else options[0]
    return images.withColumn("_b", best).select(*images.columns, "_b.grid_w", "_b.grid_h")


def tile_boxes(images: DataFrame, patch: int) -> DataFrame:
    """Patch boxes of each image's grid size, row by row."""
    ys = F.explode(F.sequence(F.lit(0).cast("long"), F.col("grid_h") - 1, F.lit(patch).cast("long")))
    xs = F.explode(F.sequence(F.lit(0).cast("long"), F.col("grid_w") - 1, F.lit(patch).cast("long")))
    return (images.withColumn("y1", ys).withColumn("x1", xs).withColumn("x2", F.col("x1") + patch).withColumn("y2", F.col("y1") + patch))
