"""Binary files in shared storage, written and read by tasks."""

from __future__ import annotations

from pyarrow import fs
from pyspark import TaskContext


def _resolve(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def open_output(uri: str):
    system, path = _resolve(uri)
    return system.open_output_stream(path, compression=None)


def open_input(uri: str):
    system, path = _resolve(uri)
    return system.open_input_file(path)


def task_file(folder: str, number: int, suffix: str) -> str:
    """A name that no other attempt of any task uses; manifests list the ones that count."""
    task = TaskContext.get()
    return f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}{suffix}"
