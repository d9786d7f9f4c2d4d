"""Timing, optional imports and the logger."""

from __future__ import annotations

import functools
import importlib
import json
import logging
import sys
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from types import ModuleType
from typing import Any


class _JSON(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"time": self.formatTime(record), "level": record.levelname, "event": record.getMessage(), **getattr(record, "context", {})}, default=str)


def logger(name: str = "seriesgrove", level: str = "WARNING", as_json: bool = False) -> logging.Logger:
    """The engine's logger; lines of JSON if asked for."""
    out = logging.getLogger(name)
    if not out.handlers:
        handler = logging.StreamHandler(sys.stderr)
        out.addHandler(handler)
        out.propagate = False
    out.handlers[0].setFormatter(_JSON() if as_json else logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
    out.setLevel(level.upper())
    return out


@contextmanager
def timed(name: str, say: Callable[[str], Any] | None = None) -> Iterator[Callable[[], float]]:
    """Measures a block; gives a function that tells the seconds so far."""
    began = time.perf_counter()
    try:
        yield lambda: time.perf_counter() - began
    finally:
        (say or logger().info)(f"{name} took {time.perf_counter() - began:.2f} s")


def timer(name: str) -> Callable:
    """``timed`` as a decorator."""

    def add(f: Callable) -> Callable:
        @functools.wraps(f)
        def run(*a: Any, **k: Any) -> Any:  # noqa: ANN401
            with timed(name):
                return f(*a, **k)

        return run

    return add


def optional_import(name: str, needed: bool = False) -> tuple[ModuleType | None, bool]:
    """(module, True), or (None, False) if it isn't installed; an ImportError with advice if it is ``needed``."""
    try:
        return importlib.import_module(name), True
    except ImportError as e:
        if needed:
            raise ImportError(f"{name} is not installed; this function needs it") from e
        return None, False
