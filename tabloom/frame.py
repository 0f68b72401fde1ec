"""The train and test rows of a data set as one DataFrame.

``_split`` says which side a row is on and ``_row_id`` names it; both replace the positions by which tables are usually cut
and glued. Operators take a ``TrainTest`` and return a new one; nothing is changed in place and nothing runs until an action.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLIT, ROW_ID = "_split", "_row_id"


@dataclass(frozen=True)
class TrainTest:
    df: DataFrame

    @classmethod
    def from_pair(cls, train: DataFrame, test: DataFrame, row_id: str | None = None) -> TrainTest:
        """Union by name; a column that one side lacks is null there. ``row_id``: a unique column, if there is one."""
        tag = lambda df, side: df.withColumn(SPLIT, F.lit(side))
        both = tag(train, "train").unionByName(tag(test, "test"), allowMissingColumns=True)
        return cls(both.withColumn(ROW_ID, F.col(row_id)) if row_id else both)

    @classmethod
    def from_null_target(cls, df: DataFrame, target: str, row_id: str | None = None) -> TrainTest:
        """Rows without a target are the test rows."""
        return cls.marked(df, F.col(target).isNotNull(), row_id)

    @classmethod
    def marked(cls, df: DataFrame, is_train: Column, row_id: str | None = None) -> TrainTest:
        out = df.withColumn(SPLIT, F.when(is_train, "train").otherwise("test"))
        return cls(out.withColumn(ROW_ID, F.col(row_id)) if row_id else out)

    @property
    def train(self) -> DataFrame:
        return self.df.where(F.col(SPLIT) == "train").drop(SPLIT, ROW_ID)

    @property
    def test(self) -> DataFrame:
        return self.df.where(F.col(SPLIT) == "test").drop(SPLIT, ROW_ID)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c not in (SPLIT, ROW_ID)]

    @property
    def train_rows(self) -> DataFrame:
        return self.df.where(F.col(SPLIT) == "train")

    def select(self, *columns: Column | str) -> TrainTest:
        keep = [c for c in (SPLIT, ROW_ID) if c in self.df.columns]
        return TrainTest(self.df.select(*keep, *columns))
