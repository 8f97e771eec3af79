"""User models of this Python worker, by name.

Importable on its own: a function shipped to the workers refers to this module instead of
carrying a copy of the cache, so the cache outlives a task.
"""

from __future__ import annotations

_MODELS: dict = {}


def get(name: str, factory):
    """The worker's model of that name, built on first use."""
    if name not in _MODELS:
        _MODELS[name] = factory()
    return _MODELS[name]
