"""Features and label for a model (P9, P18, M8): a preparation that is fitted once, kept, and
applied to any table.

The steps are the usual ones in their usual order, each an option: imputation, joint removal of
rows that lack a feature (labels stay aligned, since features and label are columns of one
table), flags to numbers and texts to the levels seen in training (others are missing), filling
of what is missing, ordinal or one-hot encoding, scaling. Fitting gathers medians, levels and
moments of the training rows; applying is one projection with a fixed schema.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, FloatType, NumericType

from wardlens.operators import derive as dv
from wardlens.operators import features as ft

ENCODINGS = (None, "ordinal", "onehot")


def drop_missing(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows that have every feature; whatever else a row holds, its label included, goes or
    stays with it. NaN counts as missing."""
    return df.na.drop("any", subset=list(features))


def outcome(name: str, died, los, path: Column, within: float | None = 1, wards: Sequence[str] = dv.CRITICAL_WARDS_H1,
            ignore_admit_ward: bool = False) -> Column:
    """The label by its name: CriticalEvent, CriticalCare or Mortality within some days."""
    makers = {
        "CriticalEvent": lambda: dv.critical_event(died, los, path, within, wards, ignore_admit_ward),
        "CriticalCare": lambda: dv.critical_care(path, wards, within, ignore_admit_ward),
        "Mortality": lambda: dv.mortality(died, los, within),
    }
    if name not in makers:
        raise ValueError(f"unknown outcome {name}; one of {sorted(makers)}")
    return makers[name]()


def no_nan(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NaN, which is not missing to Spark, as null."""
    real = [c for c in cols if isinstance(df.schema[c].dataType, (DoubleType, FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in real}) if real else df


def kinds_of(df: DataFrame, features: Sequence[str]) -> dict[str, str]:
    """number, flag or level of each feature, by its type."""
    kind = lambda t: "flag" if isinstance(t, BooleanType) else "number" if isinstance(t, NumericType) else "level"
    return {c: kind(df.schema[c].dataType) for c in features}


@dataclass(frozen=True)
class Preparation:
    """A fitted preparation. ``fit`` makes one, ``transform`` applies it, ``save`` and ``load``
    keep it as one line of JSON in shared storage."""

    kinds: dict[str, str]
    dropna: bool = False
    fillna: bool = False
    encoding: str | None = None
    medians: dict[str, float] = field(default_factory=dict)
    static: dict[str, object] = field(default_factory=dict)
    levels: dict[str, list[str]] = field(default_factory=dict)
    moments: dict[str, list[float]] = field(default_factory=dict)

    @classmethod
    def fit(cls, train: DataFrame, features: Sequence[str], dropna: bool = False, fillna: bool = False,
            encoding: str | None = None, imputation: bool = False, scale: bool = False,
            static: Mapping[str, object] = ft.STATIC_IMPUTATION) -> Preparation:
        """``imputation`` fills numbers with the training median and the columns of ``static``
        with their fixed value."""
        if encoding not in ENCODINGS:
            raise ValueError(f"encoding is one of {ENCODINGS}")
        kinds, train = kinds_of(train, features), no_nan(train, features)
        numbers = [c for c, k in kinds.items() if k == "number"]
        fixed = {c: v for c, v in static.items() if c in kinds} if imputation else {}
        middle = {c: v for c, v in ft.fit_medians(train, [c for c in numbers if c not in fixed]).items() if v is not None} \
            if imputation and set(numbers) - set(fixed) else {}
        prep = cls(kinds, dropna, fillna, None, middle, fixed)
        texts = [c for c, k in kinds.items() if k == "level"]
        clean = prep._missing(train)
        levels = ft.fit_levels(clean, texts) if texts else {}
        prep = cls(kinds, dropna, fillna, encoding, middle, fixed, levels)
        moments = {}
        if scale and numbers:
            moments = {c: [m or 0.0, s or 0.0] for c, (m, s) in ft.fit_moments(prep._filled(clean), numbers).items()}
        return cls(kinds, dropna, fillna, encoding, middle, fixed, levels, moments)

    def _missing(self, df: DataFrame) -> DataFrame:
        out = ft.impute_static(df, self.static)
        out = out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(m))) for c, m in self.medians.items()})
        return drop_missing(out, list(self.kinds)) if self.dropna else out

    def _filled(self, df: DataFrame) -> DataFrame:
        """Flags as numbers, texts as known levels, and what is missing filled."""
        known = lambda c: F.when(F.col(c).isin(self.levels[c]), F.col(c))
        out = df.withColumns({c: F.col(c).cast("double") if k == "flag" else known(c) for c, k in self.kinds.items() if k != "number"})
        return ft.fill_na(out, list(self.kinds)) if self.fillna else out

    def columns(self) -> list[str]:
        """The feature columns that ``transform`` gives."""
        if self.encoding != "onehot":
            return list(self.kinds)
        plain = [c for c, k in self.kinds.items() if k != "level"]
        return plain + [f"{c}__{x}" for c, k in self.kinds.items() if k == "level" for x in self._codes(c)]

    def _codes(self, c: str) -> list[str]:
        return [*self.levels[c], *([ft.LEVEL_FILL] if self.fillna and ft.LEVEL_FILL not in self.levels[c] else [])]

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``keep`` columns (keys, label) as they are, then the prepared features."""
        out = self._filled(self._missing(no_nan(df.select(*keep, *self.kinds), list(self.kinds))))
        if self.moments:
            out = ft.standard_scale(out, list(self.moments), self.moments)
        levels = {c: self._codes(c) for c, k in self.kinds.items() if k == "level"}
        if self.encoding == "ordinal" and levels:
            out = ft.ordinal_encode(out, list(levels), levels)
        elif self.encoding == "onehot" and levels:
            out = ft.onehot(out, list(levels), levels)
        return out.select(*keep, *self.columns())

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Preparation:
        return cls(**json.loads(spark.read.text(path, wholetext=True).first()["value"]))


def xy(df: DataFrame, key: str, features: Sequence[str], label: Column, train: Column | None = None,
       redundant: Sequence[str] = (), **options) -> tuple[DataFrame, Preparation]:
    """(key, label, prepared features) of ``df`` and the preparation, fitted on the rows where
    ``train`` holds (all by default). Without ``features`` every column but the key and the
    ``redundant`` ones is one."""
    use = list(features) or [c for c in df.columns if c != key and c not in redundant]
    t = df.withColumn("label", label.cast("int"))
    prep = Preparation.fit(t.where(train) if train is not None else t, use, **options)
    return prep.transform(t, [key, "label"]), prep
