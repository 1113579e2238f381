from __future__ import annotations

import random


def prose(seed: int, n: int) -> str:
    """n invented words."""
    draw = random.Random(seed)
    parts = "ba be bi bo bu da de di do du ka ke ki ko ku la le li lo lu ma me mi mo mu".split()
    return " ".join("".join(draw.choices(parts, k=draw.randint(1, 4))) for _ in range(n))
