"""State of syncs: cursors, chunks still to do, the global position; a JSON file, replaced as a whole."""

from __future__ import annotations

import json
import os
import threading
from dataclasses import dataclass, field

import pyarrow.fs as pafs

VERSION = 7


@dataclass
class State:
    """position: of a source with one log for all streams; finished: streams backfilled under it; streams: by id, cursor values and chunks."""

    path: str | None = None
    version: int = VERSION
    position: dict | None = None
    finished: set[str] = field(default_factory=set)
    streams: dict[str, dict] = field(default_factory=dict)

    def __post_init__(self):
        self._lock = threading.RLock()  # streams are synced side by side

    @classmethod
    def load(cls, path: str) -> State:
        """From a local path, or a URI of any file system that Arrow reaches, so that a driver can move."""
        fs, where = _file_system(path)
        if fs.get_file_info(where).type == pafs.FileType.NotFound:
            return cls(path)
        with fs.open_input_stream(where) as f:
            raw = json.loads(f.read())
        return cls(path, raw.get("version", 0), raw.get("position"), set(raw.get("finished", [])), raw.get("streams", {}))

    def save(self) -> None:
        if self.path is None:
            return
        with self._lock:
            kept = {k: v for k, v in self.streams.items() if v.get("cursor") or v.get("chunks") is not None}
            fs, where = _file_system(self.path)
            with fs.open_output_stream(f"{where}.new") as f:
                f.write(json.dumps({"version": self.version, "position": self.position, "finished": sorted(self.finished), "streams": kept}).encode())
            fs.move(f"{where}.new", where)

    def cursor(self, stream: str, name: str):
        return self.streams.get(stream, {}).get("cursor", {}).get(name)

    def set_cursor(self, stream: str, **values) -> None:
        self.streams.setdefault(stream, {}).setdefault("cursor", {}).update(values)
        self.save()

    def chunks(self, stream: str):
        return self.streams.get(stream, {}).get("chunks")

    def chunks_per_commit(self, stream: str) -> int | None:
        """As the plan of the chunks had it; None in files from before it was kept."""
        return self.streams.get(stream, {}).get("chunks_per_commit")

    def set_chunks(self, stream: str, chunks: list, per_commit: int | None = None) -> None:
        own = self.streams.setdefault(stream, {})
        own["chunks"] = [list(c) for c in chunks]
        own.pop("chunks_per_commit", None)
        if per_commit:
            own["chunks_per_commit"] = per_commit
        self.save()

    def remove_chunk(self, stream: str, chunk) -> None:
        self.remove_chunks(stream, [chunk])

    def remove_chunks(self, stream: str, chunks: list) -> None:
        done = {_text(c) for c in chunks}
        with self._lock:
            left = self.streams.get(stream, {}).get("chunks") or []
            self.streams[stream]["chunks"] = [c for c in left if _text(c) not in done]
        self.save()

    def set_position(self, position: dict, *finished: str) -> None:
        self.position = position
        self.finished |= set(finished)
        self.save()

    def backfilled(self, stream: str) -> bool:
        return stream in self.finished if self.position is not None else self.chunks(stream) == []

    def reset(self, stream: str) -> None:
        self.streams.pop(stream, None)
        self.finished.discard(stream)
        if self.position is not None:
            self.position.pop(stream, None)
        self.save()


def _text(chunk) -> str:
    """A chunk's text as the state file has it, to be looked up by; ends can be lists."""
    return json.dumps(list(chunk), default=str)


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))
