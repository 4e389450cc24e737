"""Files of arrays in the shared place that tasks map into memory.

A file is written to a name of the attempt and then renamed, so a task that runs again
replaces its own.  On a mounted file system it is mapped where it lies; from a store that
cannot be mapped it is copied to an unnamed temporary file first, which goes with the
process.
"""

from __future__ import annotations

import json
import struct
import tempfile
from urllib.parse import unquote, urlparse

import numpy as np
from pyarrow import fs
from pyspark import TaskContext

_OPEN: dict[str, dict[str, np.ndarray]] = {}


def write_arrays(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Write named one-dimensional arrays; each begins at a multiple of eight bytes."""
    head, at = {}, 0
    for name, array in arrays.items():
        head[name] = [array.dtype.str, len(array), at]
        at += -(-array.nbytes // 8) * 8
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    system, name = fs.FileSystem.from_uri(path)
    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
    context = TaskContext.get()
    own = f"{name}.{context.taskAttemptId() if context else 0}"
    with system.open_output_stream(own, compression=None) as out:
        out.write(struct.pack("<Q", len(text)) + text)
        for array in arrays.values():
            out.write(array.tobytes())
            out.write(b"\0" * (-array.nbytes % 8))
    system.move(own, name)


def open_arrays(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped; kept open for the tasks of this process."""
    if path not in _OPEN:
        url = urlparse(path)
        if url.scheme in ("", "file"):
            data = np.memmap(unquote(url.path), np.uint8, "r")
        else:
            system, name = fs.FileSystem.from_uri(path)
            with system.open_input_stream(name, compression=None) as source:
                copy = tempfile.TemporaryFile()
                while piece := source.read(1 << 22):
                    copy.write(piece)
            copy.flush()
            data = np.memmap(copy, np.uint8, "r")
        data = np.asarray(data)  # numpy does less for each access than with its own class of maps
        size = struct.unpack("<Q", data[:8].tobytes())[0]
        base = 8 + size
        _OPEN[path] = {
            name: data[base + at : base + at + count * np.dtype(kind).itemsize].view(kind)
            for name, (kind, count, at) in json.loads(data[8:base].tobytes()).items()
        }
    return _OPEN[path]
