"""Where a plan keeps its results: in a named folder, where finished steps are reused, or in scratch space."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.feature import Word2VecModel
from pyspark.sql import DataFrame, SparkSession

from firmnet.storage import materialize, read_text, reuse_or_write, table_exists, write_text


def fingerprint(parameters: object, *inputs: DataFrame) -> str:
    """Digest of a plan's parameters and of its inputs' columns and files: what decides the content of its steps.

    Tables that come from no file are told apart by their columns alone.
    """
    files = [(df.dtypes, sorted(df.inputFiles())) for df in inputs]
    return hashlib.sha256(json.dumps([repr(parameters), files]).encode()).hexdigest()


@dataclass(frozen=True)
class Outputs:
    """``folder=None`` stores each step anew; otherwise a finished step is read back (``if_exists='skip'``).

    A step is read back only when it was made from the same ``content`` (see :func:`fingerprint`), which is noted beside
    it: another seed, year or input never gets old tables, they are replaced.
    """

    spark: SparkSession
    folder: str | None = None
    if_exists: str = "skip"
    content: str = ""

    def _stale(self, name: str, made: str) -> bool:
        """Whether a finished step was made from something else."""
        return table_exists(self.spark, made) and read_text(self.spark, f"{self.folder}/_content/{name}") != self.content

    def table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if self.folder is None:
            return materialize(build(), name)
        path = f"{self.folder}/{name}"
        if_exists = "overwrite" if self.if_exists == "skip" and self._stale(name, path) else self.if_exists
        found = reuse_or_write(self.spark, path, build, if_exists)
        write_text(self.spark, f"{self.folder}/_content/{name}", self.content)
        return found

    def model(self, name: str, fit: Callable[[], Word2VecModel]) -> Word2VecModel:
        if self.folder is None:
            return fit()
        path = f"{self.folder}/{name}"
        if self.if_exists != "skip" or not table_exists(self.spark, f"{path}/data") or self._stale(name, f"{path}/data"):
            writer = fit().write()
            (writer if self.if_exists == "error" else writer.overwrite()).save(path)
            write_text(self.spark, f"{self.folder}/_content/{name}", self.content)
        return Word2VecModel.load(path)

    @property
    def run(self) -> str:
        """Name of the run in tables that many runs add to: the same content is the same run."""
        return self.content or uuid.uuid4().hex
