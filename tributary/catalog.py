"""Streams, what a user configured of them, and catalogs: merge, difference, validation and classification."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

FULL_REFRESH, INCREMENTAL, CDC, STRICT_CDC = "full_refresh", "incremental", "cdc", "strict_cdc"


@dataclass
class Stream:
    name: str
    namespace: str = ""
    schema: dict[str, str] = field(default_factory=dict)
    sync_modes: list[str] = field(default_factory=lambda: [FULL_REFRESH])
    primary_key: list[str] = field(default_factory=list)
    cursor_candidates: list[str] = field(default_factory=list)
    cursor: str = ""
    sync_mode: str = ""
    destination_database: str = ""
    destination_table: str = ""

    @property
    def id(self) -> str:
        return f"{self.namespace}.{self.name}" if self.namespace else self.name


@dataclass
class Configured:
    name: str
    namespace: str = ""
    chunk_column: str = ""
    partition: str = ""
    append_mode: bool = False
    normalization: bool = True
    use_source_column_names: bool = False
    filter: dict | str | None = None
    selected_columns: list[str] | None = None
    sync_new_columns: bool = True

    @property
    def id(self) -> str:
        return f"{self.namespace}.{self.name}" if self.namespace else self.name


@dataclass
class Catalog:
    streams: list[Stream] = field(default_factory=list)
    selected: list[Configured] = field(default_factory=list)

    def to_json(self) -> str:
        by_space: dict[str, list] = {}
        for c in self.selected:
            by_space.setdefault(c.namespace, []).append(asdict(c))
        return json.dumps({"selected_streams": by_space, "streams": [{"stream": asdict(s)} for s in self.streams]}, indent=1)

    @classmethod
    def from_json(cls, text: str) -> Catalog:
        raw = json.loads(text)
        return cls([Stream(**s["stream"]) for s in raw["streams"]], [Configured(**c) for group in raw["selected_streams"].values() for c in group])


def default_mode(stream: Stream) -> Stream:
    """cdc before incremental (by the first cursor in order) before strict_cdc before full refresh."""
    if stream.sync_mode:
        return stream
    for mode in (CDC, INCREMENTAL, STRICT_CDC, FULL_REFRESH):
        if mode in stream.sync_modes and (mode != INCREMENTAL or stream.cursor_candidates):
            stream.sync_mode = mode
            if mode == INCREMENTAL:
                stream.cursor = min(stream.cursor_candidates)
            break
    return stream


def new_catalog(streams: list[Stream], relational: bool = True, append: bool = False) -> Catalog:
    """All streams selected with all their columns."""
    return Catalog([default_mode(s) for s in streams], [Configured(s.name, s.namespace, append_mode=append, normalization=relational, selected_columns=sorted(s.schema)) for s in streams])


def merged_columns(old_schema: list[str], new_schema: list[str], selected: list[str] | None, sync_new: bool, system: tuple[str, ...] = ()) -> list[str]:
    """Columns of the new schema that are system columns, were selected before, or are new where new ones are synced."""
    chosen = set(selected if selected is not None else old_schema)
    return [c for c in new_schema if c in system or c in chosen or (sync_new and c not in old_schema)]


def merge(old: Catalog, new: Catalog) -> Catalog:
    """The new discovery with the user's choices of the old catalog. Streams that are new are not selected."""
    before = {s.id: s for s in old.streams}
    prefix = next((s.destination_database.split(":")[0] for s in old.streams if ":" in s.destination_database), "")
    out = Catalog()
    for s in new.streams:
        if was := before.get(s.id):
            s.sync_mode = was.sync_mode if was.sync_mode in s.sync_modes else s.sync_mode
            s.cursor = was.cursor or s.cursor
            s.destination_database, s.destination_table = was.destination_database, was.destination_table
            s.primary_key = was.primary_key or s.primary_key
        elif prefix and ":" in s.destination_database:
            s.destination_database = f"{prefix}:{s.destination_database.split(':', 1)[1]}"
        out.streams.append(default_mode(s))
    now = {s.id: s for s in out.streams}
    for c in old.selected:
        if c.id in now:
            was, is_ = before.get(c.id), now[c.id]
            c.selected_columns = merged_columns(sorted(was.schema) if was else [], sorted(is_.schema), c.selected_columns, c.sync_new_columns)
            out.selected.append(c)
    return out


_COMPARED = ("normalization", "partition", "filter", "use_source_column_names", "append_mode")


def difference(old: Catalog, new: Catalog) -> Catalog:
    """Selected streams of the new catalog that the old one lacks or has with other settings; with the old destinations."""
    streams, chosen = {s.id: s for s in old.streams}, {c.id: c for c in old.selected}
    out = Catalog()
    now = {s.id: s for s in new.streams}
    for c in new.selected:
        s, was, was_chosen = now[c.id], streams.get(c.id), chosen.get(c.id)
        if was and was_chosen:
            changed = any(getattr(c, k) != getattr(was_chosen, k) for k in _COMPARED) or s.sync_mode != was.sync_mode
            changed |= (s.destination_database, s.destination_table) != (was.destination_database, was.destination_table)
            changed |= s.sync_mode == INCREMENTAL and s.cursor != was.cursor
            if not changed:
                continue
            s.destination_database, s.destination_table = was.destination_database, was.destination_table
        out.streams.append(s)
        out.selected.append(c)
    return out


def validate(stream: Stream, source: Stream) -> None:
    """Errors in a configured stream against what its source has."""
    if stream.sync_mode not in source.sync_modes:
        raise ValueError(f"{stream.id} can't be synced by {stream.sync_mode}")
    if stream.sync_mode == INCREMENTAL:
        for c in stream.cursor.split(":"):
            if c not in source.cursor_candidates:
                raise ValueError(f"{stream.id} has no cursor {c}")
    if not set(source.primary_key) >= set(stream.primary_key):
        raise ValueError(f"{stream.id} lacks a part of its primary key")


def classify(catalog: Catalog, check=None) -> tuple[dict[str, list[Configured]], dict[str, str]]:
    """Selected streams by sync mode, and why others are left out. Nothing valid is an error."""
    by_mode: dict[str, list[Configured]] = {m: [] for m in (CDC, STRICT_CDC, INCREMENTAL, FULL_REFRESH)}
    skipped: dict[str, str] = {}
    streams = {s.id: s for s in catalog.streams}
    for c in catalog.selected:
        try:
            s = streams[c.id]
            validate(s, s)
            if check:
                check(c, s)
            by_mode[s.sync_mode].append(c)
        except (KeyError, ValueError) as e:
            skipped[c.id] = str(e)
    if not any(by_mode.values()):
        raise ValueError(f"no valid stream: {skipped}")
    return by_mode, skipped
