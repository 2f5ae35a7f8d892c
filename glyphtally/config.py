"""Settings of a run."""

from __future__ import annotations

import os
from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """seed: of shuffles and hashes; window: tokens that a pair may span; parts: slices of the corpus, the unit of parallelism for sketches.

    A corpus has one part more for each part_bytes of its files, see parts_of(): a part is one task's work where sketches
    are filled, so parts follow the input.
    """

    seed: int = 42
    window: int = 3
    parts: int = 10
    part_bytes: int = 256 << 20

    def parts_of(self, n_bytes: int) -> int:
        """Parts of a corpus whose files take n_bytes: parts at least, and none of much over part_bytes."""
        return max(self.parts, -(-n_bytes // self.part_bytes))

    @classmethod
    def from_env(cls, env=os.environ) -> Config:
        """SEED, JANELA (the window) and PARTES (the parts), where set."""
        return cls(int(env.get("SEED", cls.seed)), int(env.get("JANELA", cls.window)), int(env.get("PARTES", cls.parts)))
