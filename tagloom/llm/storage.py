"""Tables that a job writes for its own later steps, in the folder all executors share."""

from __future__ import annotations

from tagloom.sources.scratch import dropped, release, shared_dir, staged

__all__ = ["dropped", "release", "shared_dir", "staged"]
