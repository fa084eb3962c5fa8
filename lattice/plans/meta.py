"""What is known of an array besides its rows."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ArrayMeta:
    """Shape and tile shape of an array; tiles at the far edges may be smaller."""

    shape: tuple[int, ...]
    tile: tuple[int, ...]
    dtype: str = "double"

    def __post_init__(self) -> None:
        if len(self.shape) != len(self.tile) or min(*self.shape, *self.tile) < 1:
            raise ValueError(f"shape {self.shape} and tile {self.tile} do not go together")

    @property
    def tiles(self) -> tuple[int, ...]:
        return tuple(-(-n // t) for n, t in zip(self.shape, self.tile, strict=True))
