"""Column expressions shared by the operators: geometry, time, severity, vectors."""
from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from framelore import dims

BOX = ("x1", "y1", "x2", "y2")


def box(alias: str | None = None) -> tuple[Column, Column, Column, Column]:
    p = f"{alias}." if alias else ""
    return tuple(F.col(p + c) for c in BOX)


def strip(text: Column) -> Column:
    """Without white space at either end (``trim`` alone takes spaces only)."""
    return F.btrim(text, F.lit(" \t\n\r"))


def clamp(v: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), v))


def at_least(v: Column, lo: float = 0.0) -> Column:
    return F.greatest(v.cast("double"), F.lit(float(lo)))


def overlap_area(a, b) -> Column:
    ax1, ay1, ax2, ay2 = a
    bx1, by1, bx2, by2 = b
    return (at_least(F.least(ax2, bx2) - F.greatest(ax1, bx1))
            * at_least(F.least(ay2, by2) - F.greatest(ay1, by1)))


def area(b, floor: float | None = None) -> Column:
    """Box area; with ``floor`` the product is floored instead of the sides."""
    x1, y1, x2, y2 = b
    if floor is not None:
        return at_least((x2 - x1) * (y2 - y1), floor)
    return at_least(x2 - x1) * at_least(y2 - y1)


def iou(a, b, floor: float | None = None) -> Column:
    inter = overlap_area(a, b)
    union = area(a, floor) + area(b, floor) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(F.lit(0.0))


def centroid(b) -> tuple[Column, Column]:
    x1, y1, x2, y2 = b
    return (x1 + x2) / 2, (y1 + y2) / 2


def distance(p, q) -> Column:
    dx, dy = p[0] - q[0], p[1] - q[1]
    return F.sqrt(dx * dx + dy * dy)


def point_box_distance(p, b) -> Column:
    x, y = p
    x1, y1, x2, y2 = b
    dx = F.greatest((x1 - x).cast("double"), F.lit(0.0), (x - x2).cast("double"))
    dy = F.greatest((y1 - y).cast("double"), F.lit(0.0), (y - y2).cast("double"))
    return F.sqrt(dx * dx + dy * dy)


def diagonal(w: Column, h: Column) -> Column:
    return F.sqrt(w.cast("double") * w + h.cast("double") * h)


def person_scale(b) -> Column:
    x1, y1, x2, y2 = b
    return diagonal(at_least(x2 - x1, 1.0), at_least(y2 - y1, 1.0))


def aspect(b) -> Column:
    x1, y1, x2, y2 = b
    return F.when(y2 - y1 > 1, F.round((x2 - x1) / (y2 - y1), 4)).otherwise(F.lit(0.0))


def polygon_area(coords: Column) -> Column:
    """Shoelace area of a flat [x0, y0, x1, y1, ...] array."""
    n = (F.size(coords) / 2).cast("int")
    idx = F.sequence(F.lit(0), n - 1)
    x = lambda i: F.get(coords, (2 * i).cast("int"))
    y = lambda i: F.get(coords, (2 * i + 1).cast("int"))
    nxt = lambda i: F.pmod(i + 1, n)
    cross = F.aggregate(idx, F.lit(0.0), lambda acc, i: acc + (x(i) * y(nxt(i)) - x(nxt(i)) * y(i)))
    return F.abs(cross) / 2


def timecode(seconds: Column) -> Column:
    """HH:MM:SS.mmm into the footage; unknown times stay visible as dashes."""
    s = at_least(seconds)
    whole = lambda c: F.floor(c).cast("long")
    return (F.when(seconds.isNull() | F.isnan(seconds.cast("double")), F.lit("--:--:--"))
            .otherwise(F.format_string("%02d:%02d:%06.3f", whole(s / 3600),
                                       whole((s - whole(s / 3600) * 3600) / 60),
                                       (s - whole(s / 60) * 60).cast("double"))))


def lookup(mapping: dict, key: Column, default=None) -> Column:
    """A constant dictionary as a column."""
    m = F.create_map(*[F.lit(v) for v in chain.from_iterable(mapping.items())])
    out = F.element_at(m, key)
    return out if default is None else F.coalesce(out, F.lit(default))


def severity_rank(sev: Column) -> Column:
    return lookup(dims.SEVERITY_RANK, sev, 0)


def severity_name(rank: Column) -> Column:
    names = F.array(*[F.lit(s) for s in dims.SEVERITY_RANK])
    return F.get(names, F.greatest(F.lit(0), F.least(F.lit(4), rank)).cast("int"))


def severity_step(sev: Column, by: int) -> Column:
    return severity_name(severity_rank(sev) + F.lit(by))


def routing_rank(sev: Column) -> Column:
    return lookup(dims.ROUTING_RANK, F.lower(sev), 1)


def class_key(cls: Column) -> Column:
    """Vocabulary key: case- and separator-insensitive."""
    return F.translate(F.lower(F.trim(cls)), "_-", "  ")


def kind_of(cls: Column) -> Column:
    c = F.lower(F.trim(cls))
    return F.when(c.isin(dims.REGISTRY_VEHICLES), "vehicle").when(c == "person", "person")


def class_group(cls: Column) -> Column:
    """Classes that may match one another share a group; others stand alone."""
    c = F.lower(cls)
    return F.coalesce(lookup(dims.CLASS_GROUPS, c), c)


def round_score(score: Column) -> Column:
    """Three places, ties up; the tiny offset keeps floating-point noise from deciding a tie."""
    return F.round(clamp(score, 0.0, 1.0) + F.lit(1e-9), 3)


# ── vectors ──────────────────────────────────────────────────────────────────

def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def unit(a: Column, eps: float = 1e-8) -> Column:
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v)) + F.lit(eps)
    return F.transform(a, lambda v: v.cast("double") / norm)


def mean_abs_diff(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y))) / F.size(a)


def signature_similarity(a: Column, b: Column, bands: int = 3) -> Column:
    """Weighted per-block histogram intersection; blocks empty on both sides drop out."""
    start, num, den = 1, F.lit(0.0), F.lit(0.0)
    for _ in range(bands):
        for channel, size in dims.BLOCK_BINS.items():
            w = F.lit(dims.BLOCK_WEIGHTS[channel])
            pa, pb = F.slice(a, start, size), F.slice(b, start, size)
            used = (total(pa) > 0) | (total(pb) > 0)
            num = num + F.when(used, w * total(F.zip_with(pa, pb, lambda x, y: F.least(x, y)))).otherwise(0.0)
            den = den + F.when(used, w).otherwise(0.0)
            start += size
    ok = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) == start - 1)
    return F.when(ok & (den > 0), F.round(num / den, 4)).otherwise(F.lit(0.0))


def weighted_signature(a: Column, bands: int = 3) -> Column:
    """The signature with every block scaled by its weight, computed once per row.

    min(w * a, w * b) = w * min(a, b), so two weighted signatures compare in a
    single pass (see ``weighted_similarity``).
    """
    parts, start = [], 1
    for _ in range(bands):
        for channel, size in dims.BLOCK_BINS.items():
            w = dims.BLOCK_WEIGHTS[channel]
            parts.append(F.transform(F.slice(a, start, size), scale_by(w)))
            start += size
    return F.concat(*parts)


def scale_by(w: float):
    return lambda v: v * F.lit(w)


def block_use(a: Column, bands: int = 3) -> Column:
    """Per block whether the signature says anything there."""
    flags, start = [], 1
    for _ in range(bands):
        for size in dims.BLOCK_BINS.values():
            flags.append(total(F.slice(a, start, size)) > 0)
            start += size
    return F.array(*flags)


def weighted_similarity(wa: Column, ua: Column, wb: Column, ub: Column, bands: int = 3) -> Column:
    """``signature_similarity`` from precomputed ``weighted_signature`` and ``block_use``."""
    num = total(F.zip_with(wa, wb, lambda x, y: F.least(x, y)))
    den = F.lit(0.0)
    for i in range(bands * len(dims.BLOCK_BINS)):
        w = list(dims.BLOCK_WEIGHTS.values())[i % len(dims.BLOCK_BINS)]
        den = den + F.when(F.get(ua, F.lit(i)) | F.get(ub, F.lit(i)), w).otherwise(0.0)
    return F.when((F.size(wa) == F.size(wb)) & (den > 0), F.round(num / den, 4)).otherwise(F.lit(0.0))
