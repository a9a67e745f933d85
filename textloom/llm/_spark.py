"""Spark helpers of this subpackage."""

from __future__ import annotations

from textloom.shared import Scratch, delete, materialize, maybe_broadcast, run_dir, shared_dir

__all__ = ["Scratch", "delete", "materialize", "maybe_broadcast", "run_dir", "shared_dir"]
