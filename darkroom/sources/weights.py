"""Tunable weights of fusion, read from and written to TOML; every key is required."""

from __future__ import annotations

import tomllib
from dataclasses import asdict, dataclass, fields


@dataclass(frozen=True)
class Weights:
    # The keys of the file and the weights that stand where none is given.
    version: int = 1
    blur_junk: float = 0.55
    dark_junk: float = 0.45
    bright_junk: float = 0.35
    pocket_junk: float = 0.95
    screenshot_junk: float = 0.40
    text_document_junk: float = 0.70
    barcode_junk: float = 0.75
    zero_shot_junk: float = 0.65
    vlm_ephemeral_junk: float = 0.90
    blink_miss: float = 0.85
    looking_away_miss: float = 0.70
    mouth_open_miss: float = 0.40
    aesthetic_from_model: float = 0.55
    aesthetic_from_sharpness: float = 0.20
    aesthetic_from_composition: float = 0.15
    aesthetic_from_face_quality: float = 0.10
    blur_soft: float = 80.0
    blur_hard: float = 25.0
    dark_threshold: float = 0.55
    bright_threshold: float = 0.45
    junk_queue_threshold: float = 0.55
    miss_queue_threshold: float = 0.60
    experimental_mouth: bool = False

    @classmethod
    def from_toml(cls, text: str) -> Weights:
        read = tomllib.loads(text)
        missing = [f.name for f in fields(cls) if f.name not in read]
        if missing:
            raise ValueError(f"missing weights: {', '.join(missing)}")
        return cls(**{f.name: read[f.name] for f in fields(cls)})

    def to_toml(self) -> str:
        say = lambda v: str(v).lower() if isinstance(v, bool) else repr(v)
        return "".join(f"{k} = {say(v)}\n" for k, v in asdict(self).items())

    def of_reason(self, kind: str) -> float:
        """The weight behind a reason kind; 0.5 for kinds that have none."""
        # fixed values: the weight of each kind
        names = {
            "Blur": "blur_junk", "Underexposed": "dark_junk", "Overexposed": "bright_junk", "PocketShot": "pocket_junk", "Screenshot": "screenshot_junk",
            "ReceiptOrDocument": "text_document_junk", "BarcodeOrLabel": "barcode_junk", "UtilityJunk": "zero_shot_junk", "VlmEphemeral": "vlm_ephemeral_junk",
            "Blink": "blink_miss", "LookingAway": "looking_away_miss", "MouthOpen": "mouth_open_miss",
        }
        return getattr(self, names[kind]) if kind in names else 0.5
