"""Configurations of the parsers and targets (fixed values, from the formats' definitions)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Algorithm:
    id: int
    name: str
    window: int
    min_offset: int
    min_match: int
    max_match: int
    good_match: int
    max_literal_run: int
    max_chain: int = 16
    initial_offset: int = 5


#: Window, least offset, match lengths, good match, longest literal run.
ALGORITHMS = (
    Algorithm(0, "wide", 131072, 128, 2, 65535, 63, 1),
    Algorithm(1, "wide_runs", 131072, 128, 2, 255, 63, 255),
    Algorithm(2, "narrow", 32768, 128, 2, 255, 63, 1),
    Algorithm(3, "tabled_runs", 131072, 256, 2, 1023, 63, 1023),
    Algorithm(4, "tabled", 131072, 256, 2, 1023, 63, 1),
)
BY_NAME = {a.name: a for a in ALGORITHMS}


@dataclass(frozen=True)
class Target:
    name: str
    max_bytes: int
    algorithms: tuple[int, ...]
    default: int
    initial_offset: int = 4


#: Largest input, supported and default algorithms; a target's initial offset overrides the algorithm's.
TARGETS = (
    Target("asc", (1 << 24) - 1, (0, 1, 2, 3, 4), 0),
    Target("bin", (1 << 24) - 1, (0, 1, 2, 3, 4), 0),
    Target("zx", (1 << 16) - 1, (2,), 2),
    Target("bbc", (1 << 16) - 1, (0, 1, 2, 3, 4), 2),
    Target("ami", (1 << 24) - 1, (0, 2, 3, 4), 0),
)


@dataclass(frozen=True)
class Options:
    """What a compression run may choose; numbers out of range are moved to its border."""

    target: Target
    algorithm: Algorithm
    max_chain: int = 16
    good_match: int = 63
    initial_offset: int = 4
    ascii_mode: bool = False
    reverse: bool = False


def options(target: str = "bin", algorithm: str | None = None, max_chain: int = 16, good_match: int = 63, **flags: bool) -> Options:
    """Options by the target's name, with the target's default algorithm unless one that it supports is named."""
    found = next((t for t in TARGETS if t.name == target), None)
    if found is None:
        raise ValueError(f"no such target: {target}")
    chosen = next(a for a in ALGORITHMS if a.id == found.default) if algorithm is None else BY_NAME.get(algorithm)
    if chosen is None or chosen.id not in found.algorithms:
        raise ValueError(f"{target} does not take the algorithm {algorithm}")
    return Options(found, chosen, min(max(1, max_chain), 9999), min(max(2, good_match), 255), found.initial_offset, **flags)
