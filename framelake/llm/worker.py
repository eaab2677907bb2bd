"""One large model a Python worker: what an operator has loaded gives way when another needs the memory."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

_held: dict[tuple, Any] = {}


def held(key: tuple, make: Callable[[], Any]) -> Any:
    """The worker's model under this key, made if it is another one that the worker holds."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def release() -> None:
    _held.clear()
