"""Engine settings; one frozen value object, changed with ``dataclasses.replace`` or read from a JSON file."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class EngineConfig:
    """Defaults of all operators. ``penalty`` mismatches make a placement too different."""

    genome: str | None = None
    read_length: int = 100
    divisor: int = 10
    offset: int = 0
    penalty: int = 2
    ear_length: int = 5
    mismatches: int = 5
    too_many_hits: int = 500
    bucket: int = 1_000_000
    insert_size: int = 200
    clip: int = 5
    min_mapping_quality: int = -1
    tolerance: int = 1
    max_tolerance: int = 2
    hit_count: int = 3
    hit_proportion: float = 0.5
    too_many: int = 400
    rows_per_file: int = 3_000_000

    def __post_init__(self) -> None:
        if self.read_length < 1 or self.divisor < 1 or self.offset < 0:
            raise ValueError("read_length and divisor must be at least 1, offset at least 0")
        if 2 * self.ear_length > self.read_length:
            raise ValueError("two ears must fit into a read")

    def save(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=1))

    @classmethod
    def load(cls, path: str | Path) -> "EngineConfig":
        if not Path(path).exists():
            return cls()
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in json.loads(Path(path).read_text()).items() if k in known})
