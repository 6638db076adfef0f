"""The plan of a whole analysis: raw points and roads in, a family of frames out.  Nothing runs until one is used."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from routeloom.config import Settings
from routeloom.operators import candidates, clean, kinematics, legs, matching, reports, simplify, tiles


@dataclass
class Analysis:
    """``raw``: file_id, trk, seg, pt, lat, lon, ele, t, fix, hdop.  ``edges``: directed road edges with geometry."""

    raw: DataFrame
    edges: DataFrame | None = None
    settings: Settings = Settings()
    #: Keep the frames that several results share (memory first, then local disk).
    keep: bool = True

    def _kept(self, df: DataFrame) -> DataFrame:
        return df.persist(StorageLevel.MEMORY_AND_DISK) if self.keep else df

    def release(self) -> None:
        for name in ("files", "cleaned", "simplified", "located", "matched", "legs", "counts"):
            if name in self.__dict__:
                self.__dict__[name].unpersist()

    @cached_property
    def files(self) -> DataFrame:
        return self._kept(kinematics.inspect(self.raw))

    @cached_property
    def original(self) -> DataFrame:
        return kinematics.valid_points(self.raw)

    @cached_property
    def cleaned(self) -> DataFrame:
        return self._kept(clean.clean(self.original, self.settings))

    @cached_property
    def simplified(self) -> DataFrame:
        return self._kept(simplify.simplify(self.cleaned, self.settings))

    @cached_property
    def located(self) -> DataFrame:
        """Simplified points with the zone of their file's tiles and road candidates."""
        points = tiles.with_zone(self.simplified.drop("x", "y"), self.settings)
        return self._kept(candidates.with_candidates(points, self.edges, self.settings))

    @cached_property
    def matched(self) -> DataFrame:
        return self._kept(matching.match(self.located, self.edges, self.settings))

    @cached_property
    def legs(self) -> DataFrame:
        return self._kept(legs.legs(self.matched, self.settings))

    @cached_property
    def counts(self) -> DataFrame:
        return self._kept(simplify.simplify_stats(self.original, self.cleaned, self.simplified))

    @cached_property
    def status(self) -> DataFrame:
        return reports.file_status(self.files, self.cleaned, self.legs)

    @cached_property
    def alerts(self) -> DataFrame:
        return reports.alerts(self.files, self.cleaned, self.status)
