"""Files in a shared folder, by URI, from the driver or an executor."""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path on it."""
    return fs.FileSystem.from_uri(uri)


class Writer:
    """Appends to a file with a name of its own, so that a repeated task never touches another attempt's file."""

    def __init__(self, folder: str, suffix: str):
        system, path = opened(folder)
        system.create_dir(path, recursive=True)
        self.name, self.at = f"{uuid.uuid4().hex}{suffix}", 0
        self.out = system.open_output_stream(f"{path}/{self.name}", compression=None)

    def append(self, data: bytes) -> int:
        """Where the data starts."""
        at = self.at
        self.out.write(data)
        self.at += len(data)
        return at

    def close(self) -> None:
        self.out.close()
