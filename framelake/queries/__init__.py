"""Registered queries by family."""

from . import diff, frames, grid, manifest, motion, rd, samples, scalars, streaming, trajectory  # noqa: F401
