"""Layers of the parquet lake: indicators, cached steps, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

UNIVERSES = ("fortune500", "sp500")


class Lake:
    """``<root>/data_clean/indicators/<universe>/<name>.parquet`` holds finished indicators,
    ``<root>/data_cache/indicators/<universe>/<indicator>/<step>.parquet`` steps on the way."""

    def __init__(self, spark: SparkSession, root: str, universe: str = UNIVERSES[0]):
        if universe not in UNIVERSES:
            raise ValueError(f"unknown universe {universe!r}; known: {UNIVERSES}")
        self.spark, self.root, self.universe = spark, root.rstrip("/"), universe

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _stems(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        if not fs.exists(p):
            return []
        return sorted(s.getPath().getName().removesuffix(".parquet") for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet"))

    def indicator_path(self, name: str) -> str:
        return f"{self.root}/data_clean/indicators/{self.universe}/{name}.parquet"

    def step_path(self, indicator: str, step: str) -> str:
        return f"{self.root}/data_cache/indicators/{self.universe}/{indicator}/{step}.parquet"

    def indicators(self) -> list[str]:
        """Names of all indicators there are, sorted; none if the folder is absent."""
        return self._stems(f"{self.root}/data_clean/indicators/{self.universe}")

    def read_indicator(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.indicator_path(name))

    def write_indicator(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(self.indicator_path(name))

    def step(self, indicator: str, step: str) -> DataFrame | None:
        """A cached step, None if there is none."""
        p = self.step_path(indicator, step)
        return self.spark.read.parquet(p) if self._exists(p) else None

    def save_step(self, df: DataFrame, indicator: str, step: str) -> None:
        df.write.mode("overwrite").parquet(self.step_path(indicator, step))

    def computed(self, indicator: str, step: str, make) -> DataFrame:
        """The cached step, made and saved first if need be."""
        have = self.step(indicator, step)
        if have is None:
            self.save_step(make(), indicator, step)
            have = self.step(indicator, step)
        return have

    def clear(self, indicator: str, step: str | None = None) -> int:
        """Delete one step or all steps of an indicator; how many there were."""
        folder = f"{self.root}/data_cache/indicators/{self.universe}/{indicator}"
        steps = [s for s in self._stems(folder) if step in (None, s)]
        for s in steps:
            fs, p = self._fs(f"{folder}/{s}.parquet")
            fs.delete(p, True)
        return len(steps)

    def write_matrix(self, df: DataFrame) -> str:
        """The composed matrix of the universe."""
        path = f"{self.root}/data_clean/index/{self.universe}/matrix.parquet"
        df.write.mode("overwrite").parquet(path)
        return path

    def write_scores(self, df: DataFrame) -> str:
        """The index: one row per firm with scores, coverage, rank and cluster."""
        path = f"{self.root}/data_clean/index/{self.universe}/scores.parquet"
        df.write.mode("overwrite").parquet(path)
        return path

    def write_sample(self, sample: DataFrame, key: DataFrame, name: str) -> tuple[str, str]:
        """A sample to be labelled as CSV, and beside it the key that tells where its rows come from."""
        at = f"{self.root}/exports/{name}_key.parquet"
        key.write.mode("overwrite").parquet(at)
        return self.export_csv(sample, name), at

    def export_csv(self, df: DataFrame, name: str) -> str:
        path = f"{self.root}/exports/{name}"
        df.write.mode("overwrite").option("header", True).csv(path)
        return path

    def export_xlsx(self, df: DataFrame, path: str, most: int = 1_000_000) -> None:
        """A workbook of at most ``most`` rows, what a sheet can hold; needs openpyxl."""
        if df.limit(most + 1).count() > most:
            raise ValueError(f"a sheet holds at most {most} rows")
        df.toPandas().to_excel(path, index=False)
