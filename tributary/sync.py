"""Syncs of configured streams: full refresh, incremental and change capture, each safe to repeat after a crash.

Order of every step: destination commit (data, position and batch id in one), then state. A step that the destination
has and the state lacks is adopted, not applied again.
"""

from __future__ import annotations

import datetime as dt
import math
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary import types as S
from tributary.catalog import CDC, FULL_REFRESH, INCREMENTAL, STRICT_CDC, Catalog, Configured, Stream, classify
from tributary.functions import transforms
from tributary.functions.rowid import OP_TYPE, UPDATE, envelope
from tributary.operators import filters, flatten, project
from tributary.operators.chunks import Chunk
from tributary.operators.cursors import threshold
from tributary.operators.merge import write_mode
from tributary.sinks.table import Table
from tributary.sources.base import Source
from tributary.state import State
from tributary.streaming.changes import stamp

#: Commits of a backfill at most, whatever the number of its chunks.
COMMITS = 16


class Sync:
    def __init__(self, spark: SparkSession, source: Source, destination: str, state: State, *, ingested_at: dt.datetime | None = None, strict: bool = True, chunks_per_commit: int = 16, streams_at_once: int = 4):
        self.spark, self.source, self.destination, self.state, self.ingested_at, self.strict = spark, source, destination, state, ingested_at, strict
        self.chunks_per_commit, self.streams_at_once = chunks_per_commit, streams_at_once

    def table(self, stream: Stream) -> Table:
        return Table(self.spark, f"{self.destination}/{stream.destination_table or stream.id.replace('.', '__')}", strict=self.strict)

    def run(self, catalog: Catalog) -> dict[str, str]:
        """Sync all valid selected streams; returns why others were left out."""
        streams = {s.id: s for s in catalog.streams}
        modes, skipped = classify(catalog, self._check)
        steps = {FULL_REFRESH: self.full_refresh, INCREMENTAL: self.incremental, CDC: self.changes, STRICT_CDC: self.changes}
        for mode in (FULL_REFRESH, INCREMENTAL, CDC, STRICT_CDC):
            with ThreadPoolExecutor(self.streams_at_once) as pool:  # each stream has a table of its own
                for done in [pool.submit(steps[mode], c, streams[c.id]) for c in modes[mode]]:
                    done.result()
        return skipped

    def _check(self, c: Configured, s: Stream) -> None:
        if f := filters.parse(c.filter):
            filters.validate(f, self.source.table(s).schema)

    def _shape(self, df: DataFrame, c: Configured, s: Stream) -> DataFrame:
        """Filter, selection, layout: every mode has the same."""
        df = filters.apply(df, c.filter)
        keep = [n for n in df.columns if n.startswith("__") or n in (c.selected_columns or df.columns) or (c.sync_new_columns and n not in s.schema)]
        return df.select(*[df[f"`{n}`"] for n in keep])

    def _land(self, df: DataFrame, c: Configured, s: Stream) -> DataFrame:
        df = df.drop(*[n for n in df.columns if n.startswith("__")])
        df = flatten.flatten(df) if c.normalization else flatten.raw_json(df)
        own = [n for n in df.columns if n.startswith("_")]
        renamed = project.destination_names([n for n in df.columns if n not in own], c.use_source_column_names)
        return df.select(*[df[f"`{n}`"].alias(renamed.get(n, n)) for n in df.columns])

    @staticmethod
    def _partition(c: Configured) -> str | None:
        """The stream's partition specification under the names that its columns have at the destination."""
        if not c.partition:
            return None
        name = lambda n: n if c.use_source_column_names or n.startswith("_") else S.reformat(n)
        return "".join(f"/{{{name(column)}, {how}{f'[{arg}]' if arg else ''}}}" for column, how, arg in transforms.parse_spec(c.partition))

    def full_refresh(self, c: Configured, s: Stream) -> None:
        """All rows in place of what was there, in one commit: readers see the old table until it is done."""
        self.state.reset(s.id)
        rows = self._land(envelope(self._shape(self.source.table(s), c, s), s.primary_key, ingested_at=self.ingested_at), c, s)
        self.table(s).commit(rows, batch_id=f"{s.id}_full", replace=True, partition=self._partition(c))

    def backfill(self, c: Configured, s: Stream, bounds: dict | None = None) -> None:
        """The chunks that are left, some consecutive ones at a time, committed under an id of their own.

        A commit has ``chunks_per_commit`` chunks, or more where the plan is longer than ``COMMITS`` such commits: a
        commit costs a job and a pass over the log and the state, so their number mustn't grow with the table. The state
        keeps how many, since a restart must make the same groups to know those that the destination has."""
        if self.state.chunks(s.id) is None:
            plan = [(x.low, x.high) for x in self.source.chunks(s)]
            self.state.set_chunks(s.id, plan, max(self.chunks_per_commit, math.ceil(len(plan) / COMMITS)))
        table, left = self.table(s), list(self.state.chunks(s.id))
        each = self.state.chunks_per_commit(s.id) or self.chunks_per_commit
        for group in (left[i : i + each] for i in range(0, len(left), each)):
            rows = self.source.scan_many(s, [Chunk(low, high) for low, high in group])
            if bounds:
                rows = rows.where(threshold(bounds))
            rows = self._land(envelope(self._shape(rows, c, s), s.primary_key, ingested_at=self.ingested_at), c, s)
            table.commit(rows, batch_id=f"{s.id}_min[{group[0][0]}]-max[{group[-1][1]}]", mode="append", dedup_inserts=True, partition=self._partition(c))
            self.state.remove_chunks(s.id, group)

    def incremental(self, c: Configured, s: Stream) -> None:
        """The first time: maxima, then a backfill up to them. Later: rows past the cursor and up to the new maxima, as updates."""
        cursors = s.cursor.split(":")
        table = self.table(s)
        committed = (table.meta().get("position") or {}).get("cursor")
        if committed and committed != self.state.streams.get(s.id, {}).get("cursor"):
            self.state.set_cursor(s.id, **committed)  # the destination is ahead
        top = self.source.max_cursor(s, cursors)
        as_text = lambda d: {k: v.isoformat(sep=" ") if isinstance(v, dt.datetime) else v for k, v in d.items()}
        if self.state.cursor(s.id, cursors[0]) is None:
            self.backfill(c, s, top)
            table.commit(None, batch_id=f"{s.id}_cursor_{as_text(top)}", position={"cursor": as_text(top)})
            self.state.set_cursor(s.id, **as_text(top))
            return
        last = {k: self.state.cursor(s.id, k) for k in cursors}
        # rows that arrive after the maxima were read are left to the next run, so an append log has each row once
        rows = self._shape(self.source.incremental(s, last).where(threshold(top)), c, s)
        new = {k: max(as_text(top)[k], last[k]) if top[k] is not None and last[k] is not None else (as_text(top)[k] if top[k] is not None else last[k]) for k in cursors}
        landed = self._land(envelope(rows, s.primary_key, UPDATE, self.ingested_at), c, s)
        mode = write_mode(False, c.append_mode, True)
        table.commit(landed, batch_id=f"{s.id}_{new}", mode=mode, order=[n for n in (cursors[0],) if n in landed.columns] or None, position={"cursor": new}, partition=self._partition(c))
        self.state.set_cursor(s.id, **new)

    def changes(self, c: Configured, s: Stream) -> None:
        """Pin the end, backfill a stream that has none (not under strict_cdc), then apply changes up to the end."""
        table = self.table(s)
        committed = (table.meta().get("position") or {}).get("log")
        own = (self.state.position or {}).get(s.id)
        if committed is not None and committed != own:
            own = committed  # the destination is ahead; its commit is adopted
            self.state.set_position((self.state.position or {}) | {s.id: own}, s.id)
        end = self.source.end_position(s)
        if s.sync_mode == CDC and s.id not in self.state.finished:
            if own is None:  # kept before the snapshot begins: a restart reads changes from here, not from its own start
                own = end
                self.state.set_position((self.state.position or {}) | {s.id: own})
            self.backfill(c, s)
            table.commit(None, batch_id=f"{s.id}_snapshot_{own}", position={"log": own}, dedup_inserts=True)
            self.state.set_position((self.state.position or {}) | {s.id: own}, s.id)
        if own == end:
            return
        overlap = bool(table.meta().get("dedup_inserts"))
        log = self._shape(self.source.changes(s, own, end), c, s)
        stamped = stamp(log, s.primary_key, "__kind", F.col("__at"), overlap, self.ingested_at)
        mode = write_mode(False, c.append_mode, True)
        if mode == "upsert":
            from tributary.operators.merge import latest

            stamped = latest(stamped, ["__position"])
        table.commit(self._land(stamped, c, s), batch_id=f"{s.id}_{own}_{end}", mode=mode, order=[OP_TYPE], position={"log": end}, dedup_inserts=False, partition=self._partition(c))
        self.state.set_position((self.state.position or {}) | {s.id: end}, s.id)

    def clear(self, catalog: Catalog) -> None:
        """Drop the tables and state of selected streams."""
        streams = {s.id: s for s in catalog.streams}
        for c in catalog.selected:
            self.table(streams[c.id]).clear()
            self.state.reset(c.id)
