"""Thresholds. Every number is a policy choice and a plain literal."""
from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class RuleConfig:
    min_severity: str = "low"
    min_score: float = 0.40
    cooldown_s: float = 12.0
    weapon_conf: float = 0.45
    weapon_proximity: float = 0.25
    grip_enabled: bool = True
    grip_tolerance: float = 0.18
    grip_kp_conf: float = 0.30
    carried_overlap: float = 0.55
    carried_factor: float = 0.75
    tool_conf: float = 0.40
    collision_iou: float = 0.08
    collision_min_speed: float = 0.05
    collision_decel: float = 0.45
    collision_frames: int = 2
    collision_settle_s: float = 1.0
    collision_silence_s: float = 5.0
    pedestrian_min_speed: float = 0.03
    left_scene_window_s: float = 25.0
    left_scene_speed: float = 0.04
    snatch_approach: float = 0.03
    snatch_contact: float = 0.10
    snatch_max_contact_s: float = 2.5
    snatch_ratio: float = 1.05
    snatch_watch_s: float = 2.0
    snatch_min_score: float = 0.45
    action_conf: float = 0.40
    action_conf_brief: float = 0.25
    violence_needs_two: bool = True
    crowd_density: int = 8
    crowd_surge: int = 5
    crowd_window_s: float = 4.0
    crowd_dispersal: int = 5
    loiter_s: float = 90.0
    loiter_spread: float = 0.06
    anchor_reset: float = 0.06
    unattended_s: float = 45.0
    unattended_distance: float = 0.22
    zone_severity: str = "medium"
    after_hours_start: int = 22
    after_hours_end: int = 6
    caption_min_score: float = 0.40
    track_iou: float = 0.3
    track_max_misses: int = 15

    def patched(self, **changes) -> "RuleConfig":
        """A copy with known, non-null settings replaced; unknown keys are ignored."""
        known = {k: v for k, v in changes.items() if k in self.__dataclass_fields__ and v is not None}
        return replace(self, **known)


DEFAULTS = RuleConfig()
