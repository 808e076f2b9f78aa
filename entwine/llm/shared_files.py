"""Files in the shared folder that Python workers write and map.

A folder that is mounted (file: or a bare path) is used where it lies: all hosts see it.
From any other file system that Arrow knows, a worker fetches a file once into the working
folder of its executor. Files appear under their name only when they are whole, so a task that
runs again, or twice, leaves the same file.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import lru_cache

import numpy as np
from pyarrow import fs

from entwine.functions.session import located as _at
from entwine.llm.elias_fano import mapped, packed


def put(uri: str, arrays: dict[str, np.ndarray]) -> str:
    """Write arrays as one file; its name."""
    system, path = _at(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex[:12]}"
    with system.open_output_stream(part) as out:
        out.write(packed(arrays))
    system.move(part, path)
    return uri


@lru_cache(256)
def arrays_of(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped."""
    system, path = _at(uri)
    if isinstance(system, fs.LocalFileSystem):
        return mapped(path)
    local = os.path.join(os.getcwd(), f"fetched-{uri.rsplit('/', 2)[-2]}-{os.path.basename(path)}")
    if not os.path.exists(local):
        handle, part = tempfile.mkstemp(dir=os.path.dirname(local))
        with system.open_input_stream(path) as source, os.fdopen(handle, "wb") as out:
            while block := source.read(1 << 22):
                out.write(block)
        os.replace(part, local)
    return mapped(local)
