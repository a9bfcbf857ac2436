"""Thresholds of a scan; every one has a default."""

from __future__ import annotations

from dataclasses import dataclass

#: Position of each tier in the gate's order of confidence; the other tiers never fail it. Fixed values.
FAIL_RANK = {"inconsistent-update": 0, "exact-normalized": 1, "internal-repeat": 2, "exact-region": 3, "near-normalized": 4, "inline-assisted": 5}


@dataclass(frozen=True)
class Thresholds:
    min_unit_tokens: int = 40
    min_seq_tokens: int = 30
    gram: int = 5
    landmark_gram: int = 3
    candidate_sim: float = 0.70
    df_cap: int = 50
    owner_cap: int = 40
    landmark_fan_out: int = 3
    landmark_step: int = 8
    shared_landmarks: int = 2
    histogram_bin: int = 4
    histogram_offsets: int = 4
    histogram_min_votes: int = 5
    max_divergence: float = 0.18
    fold_min_repeats: int = 3
    fold_max_period: int = 8
    api_sim: float = 0.5
    api_min_rare: int = 3
    drift_epsilon: float = 0.01
    micro_region_tokens: int = 60
    minified_bytes: int = 512
    markers: tuple[str, ...] = ("@generated", "DO NOT EDIT", "Code generated by")
    max_candidates: int = 3
    top: int = 20


DEFAULT = Thresholds()


def load(root: str) -> Thresholds:
    """Thresholds from root/twinsight.toml: keys of its [thresholds] table; unknown keys are ignored, a missing file gives the defaults."""
    import tomllib
    from dataclasses import fields
    from pathlib import Path

    path = Path(root) / "twinsight.toml"
    if not path.exists():
        return DEFAULT
    given = tomllib.loads(path.read_text(encoding="utf-8")).get("thresholds", {})
    known = {f.name for f in fields(Thresholds)}
    return Thresholds(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in known})
