"""File actions of a plan (source, target): move, copy, symlink, hardlink."""

from __future__ import annotations

import os
from collections.abc import Iterator
from enum import Enum

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .. import storage


class FileAction(str, Enum):
    MOVE = "move"
    COPY = "copy"
    SYMLINK = "symlink"
    HARDLINK = "hardlink"

    @classmethod
    def of(cls, name: str | FileAction) -> FileAction:
        try:
            return cls(name)
        except ValueError as e:
            raise ValueError(f"no action {name!r}; one of {[a.value for a in cls]}") from e


def handle(source: str, target: str, action: FileAction, overwrite: bool = False) -> str:
    """Acts on one file; ``done``, or ``already`` if an earlier attempt of the same action shows."""
    if not storage.exists(source):
        if action == FileAction.MOVE and storage.exists(target):
            return "already"
        raise FileNotFoundError(source)
    if storage.exists(target) or os.path.islink(storage.located(target)[1]):
        if _same(source, target, action):
            return "already"
        if not overwrite:
            raise FileExistsError(target)
    if action == FileAction.MOVE:
        storage.move(source, target)
        return "done"
    part = f"{target}.{storage.attempt_name()}.part"
    if action == FileAction.COPY:
        system, path = storage.located(source)
        goal = storage.located(part)[1]
        system.create_dir(goal.rpartition("/")[0], recursive=True)
        system.copy_file(path, goal)
    else:
        system, goal = storage.located(part)
        if type(system).__name__ != "LocalFileSystem":
            raise ValueError(f"{action.value} needs a local or mounted file system")
        system.create_dir(goal.rpartition("/")[0], recursive=True)
        at = os.path.realpath(storage.located(source)[1], strict=True)
        (os.symlink if action == FileAction.SYMLINK else os.link)(at, goal)
        os.replace(goal, storage.located(target)[1])
        return "done"
    storage.move(part, target)
    return "done"


def _same(source: str, target: str, action: FileAction) -> bool:
    """Whether the target already is what the action would make of the source."""
    (system, a), (_, b) = storage.located(source), storage.located(target)
    if type(system).__name__ != "LocalFileSystem" or action == FileAction.MOVE:
        return False
    if action == FileAction.SYMLINK:
        return os.path.islink(b) and os.path.realpath(b) == os.path.realpath(a)
    if action == FileAction.HARDLINK:
        return os.path.samefile(a, b) and not os.path.islink(b)
    return False


def act(spark: SparkSession, plan: DataFrame, action: str | FileAction, overwrite: bool = False) -> DataFrame:
    """Stored rows (source, target, status, error) of the action on every file of the plan; it runs once, and a retried task finds what it did."""
    kind = FileAction.of(action)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for source, target in zip(b["source"], b["target"], strict=True):
                try:
                    out.append((source, target, handle(source, target, kind, overwrite), None))
                except (OSError, ValueError) as e:
                    out.append((source, target, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["source", "target", "status", "error"])

    return storage.stored(spark, storage.spread(plan.select("source", "target"), "target").mapInPandas(run, "source string, target string, status string, error string"), "actions")
