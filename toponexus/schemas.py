"""Schemas of the linkage tables. Order matters to many operators, so sources carry a row_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "date": T.DateType(), "strings": T.ArrayType(T.StringType())}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (part.rsplit(" ", 1) for part in text.split(", "))])


#: Names waiting for a counterpart on either side.
NAMES = _struct("row_id long, name string, district string, counterpart string")
DISTRICTS = _struct("district_en string, district_ar string")
PAIRS = _struct("key string, value string")
TOKENS = _struct("token string, cands strings")
RESULTS = _struct("English Name string, English District string, Best Arabic Match string, Match Score double")
ACCEPTED = _struct("English Name string, English District string, Accepted Arabic Name string, Match Score double")
REVIEW = T.StructType(RESULTS.fields + [T.StructField(f"Cand{i}{end}", T.DoubleType() if end == "_Score" else T.StringType()) for i in (1, 2, 3) for end in ("", "_Lat", "_Score")])
TIMING = _struct("District string, EngCount long, CandCount long, SquareSize long, Method string, ElapsedSeconds double")
#: Columns of the public gazetteer dump, in its documented order.
GAZETTEER = _struct(
    "geonameid int, name string, asciiname string, alternatenames string, latitude double, longitude double, feature_class string, feature_code string, country_code string, "
    "cc2 string, admin1_code string, admin2_code string, admin3_code string, admin4_code string, population long, elevation int, dem int, timezone string, modification_date date"
)
ALTERNATE_NAMES = _struct(
    "alternateNameId int, geonameid int, isolanguage string, alternate_name string, isPreferredName string, isShortName string, isColloquial string, isHistoric string, from string, to string"
)


def check(frame: DataFrame, schema: T.StructType, what: str) -> DataFrame:
    """``frame`` with the columns of ``schema``; a missing column or another type is an error."""
    for field in schema.fields:
        if field.name not in frame.columns:
            raise ValueError(f"{what}: column {field.name!r} is missing")
        if frame.schema[field.name].dataType != field.dataType:
            raise ValueError(f"{what}: column {field.name!r} is {frame.schema[field.name].dataType.simpleString()}, not {field.dataType.simpleString()}")
    return frame.select([f"`{field.name}`" for field in schema.fields])
