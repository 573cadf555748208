"""Callbacks for prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame


class SaveFeatures:
    """Keeps the frames that models saw at each step: give it as before_predict_callback."""

    def __init__(self):
        self.frames: list[DataFrame] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        self.frames.append(df)
        return df

    def get_features(self, with_step: bool = False) -> DataFrame:
        """All rows; step tells which step ahead they were made for."""
        if not self.frames:
            raise ValueError("no prediction was made with this callback")
        out = self.frames[0]
        for df in self.frames[1:]:
            out = out.unionByName(df, allowMissingColumns=True)
        return out if with_step or "step" not in out.columns else out.drop("step")
