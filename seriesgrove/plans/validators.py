"""Checks of arguments on the driver."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from .. import storage


def directory(spark: SparkSession, path: str, create: bool = False) -> str:
    """A directory that is there, or is made; anything else is a ValueError."""
    fs, at = storage.hadoop(spark, path), storage.hadoop_path(spark, path)
    if not fs.exists(at):
        if not create:
            raise ValueError(f"no directory {path!r}")
        fs.mkdirs(at)
    elif not fs.getFileStatus(at).isDirectory():
        raise ValueError(f"{path!r} is not a directory")
    return path


def modalities(asked: list[str] | str | None) -> list[str] | None:
    """A list of modalities, or none for all; text is split at commas."""
    if asked is None or asked in ("*", "all"):
        return None
    return asked.split(",") if isinstance(asked, str) else list(asked)


def jobs(n: int | None, cpus: int | None = None) -> int:
    """The number of parallel jobs: none or less means two below the number of CPUs, more than there are means all."""
    cpus = cpus or os.cpu_count() or 1
    return max(1, cpus - 2) if n is None or n <= 0 else min(n, cpus)


def spacing(text: str) -> tuple[float, float, float]:
    """``a,b,c`` as three numbers."""
    parts = text.split(",")
    if len(parts) != 3:
        raise ValueError(f"spacing is three numbers, not {text!r}")
    return float(parts[0]), float(parts[1]), float(parts[2])


def max_path_length(path: str = "/") -> int:
    """The operating system's limit on a path's length."""
    try:
        return os.pathconf(path, "PC_PATH_MAX")
    except (OSError, ValueError, AttributeError):
        return 4096


def max_name_length(path: str = "/") -> int:
    """The operating system's limit on a file name's length."""
    try:
        return os.pathconf(path, "PC_NAME_MAX")
    except (OSError, ValueError, AttributeError):
        return 255
