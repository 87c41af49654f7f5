"""Files that tasks read and write by themselves: the engine's, under its old name."""

from pagelake.stores import PREFIX, Stores

__all__ = ["PREFIX", "Stores"]
