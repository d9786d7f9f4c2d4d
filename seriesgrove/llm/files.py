"""Files in the shared folder, written and read by tasks."""

from __future__ import annotations

from typing import Any


def opened(uri: str, mode: str) -> Any:  # noqa: ANN401
    """A binary file of any file system that pyarrow knows; mode r (seekable) or w."""
    from pyarrow import fs

    system, path = (fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")) if uri.startswith("file:") else fs.FileSystem.from_uri(uri)
    if mode == "r":
        return system.open_input_file(path)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def own_file(folder: str, suffix: str) -> str:
    """A name that no other attempt of this task uses, so that only committed attempts' files are read."""
    from pyspark import TaskContext

    c = TaskContext.get()
    return f"{folder}/part-{c.partitionId():06d}-{c.taskAttemptId()}{suffix}"
