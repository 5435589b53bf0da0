"""A log-structured index of sorted immutable runs, kept as tables in a folder that driver and executors share."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame

from tessera.llm.scratch import Folder, Scratch


class SortedRuns:
    """Runs by level. A new batch becomes a run of level 0; a level of `fanout` runs is compacted into one of the next.

    keys identify an entry, merge gives the aggregates that fold entries of one key into one. Each entry is thus
    rewritten once a level, a logarithmic number of times, and a lookup merge-joins few runs.

    Runs are never changed. Each add publishes a manifest that names the runs of each level, under the next number; a
    manifest without its end mark does not count. A session that dies leaves the index as its last manifest says, and
    SortedRuns over the same folder opens it there. One session writes at a time; readers keep what they opened until the
    compaction after the next.
    """

    def __init__(self, folder: Scratch | Folder, keys: list[str], merge: list[Column], fanout: int = 2):
        self.folder, self.keys, self.merge, self.fanout = folder, keys, merge, fanout
        self.levels: list[list[DataFrame]] = []
        self.version, self._stale = 0, []
        found = [int(name) for name in folder.names("manifest") if folder.exists(f"manifest/{name}/_SUCCESS")]
        if found:
            self.version = max(found)
            said = json.loads(folder.read(f"manifest/{self.version:06d}", "text").first().value)
            self.levels = [[folder.read(run) for run in level] for level in said["levels"]]
            self._stale = said["stale"]

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def rows(self) -> DataFrame | None:
        """All entries; a key may have one in each run."""
        return reduce(DataFrame.unionByName, self.runs()) if self.runs() else None

    def merged(self) -> DataFrame | None:
        """All entries, one for each key."""
        rows = self.rows()
        return None if rows is None else rows.groupBy(*self.keys).agg(*self.merge)

    def add(self, entries: DataFrame) -> None:
        """Write entries (one for each key) as a sorted run, compact what is full, publish."""
        levels, gone, level = [list(x) for x in self.levels], [], 0
        run = self._write(entries)
        while True:
            if level == len(levels):
                levels.append([])
            levels[level].append(run)
            if len(levels[level]) < self.fanout:
                break
            full, levels[level] = levels[level], []
            run = self._write(reduce(DataFrame.unionByName, full).groupBy(*self.keys).agg(*self.merge))
            gone += [r.kept_as for r in full]
            level += 1
        if gone and self.folder.lasting:  # readers may hold what has just been compacted
            gone, self._stale = self._stale, gone
        self.version += 1
        said = json.dumps({"levels": [[r.kept_as for r in x] for x in levels], "stale": self._stale})
        spark = self.folder.spark
        spark.createDataFrame([(said,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder.path}/manifest/{self.version:06d}")
        self.levels = levels
        for name in gone:
            self.folder.remove(name)

    def drop(self) -> None:
        """Delete all runs."""
        self.folder.drop(*self.runs())
        self.levels, self._stale = [], []

    def _write(self, entries: DataFrame) -> DataFrame:
        return self.folder.keep(entries.sortWithinPartitions(*self.keys), "run")
