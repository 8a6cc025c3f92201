"""Named options of the operators."""

from __future__ import annotations

from enum import StrEnum

from .errors import InvalidParameters


class Option(StrEnum):
    @classmethod
    def from_str(cls, text: str):
        """The member of this name or value, in either case."""
        for member in cls:
            if text.upper() in (member.name, member.value.upper()):
                return member
        raise InvalidParameters(f"{text!r} is none of {', '.join(m.name for m in cls)}")


class GeoFileType(Option):
    SHAPE_FILE = "shapefile"
    WKB_FILE = "wkb"
    WKT_FILE = "wkt"
    JSON_FILE = "geojson"


class GeoRelationship(Option):
    CONTAINS = "contains"
    INTERSECTS = "intersects"
    TOUCHES = "touches"
    WITHIN = "within"


class AggregationType(Option):
    COUNT = "count"
    SUM = "sum"
    AVG = "avg"
    MIN = "min"
    MAX = "max"


class AdjacencyType(Option):
    BINARY = "binary"
    EXPONENTIAL_CENTROID_DISTANCE = "exponential_centroid_distance"
    EXPONENTIAL_DISTANCE = "exponential_distance"
    COMMON_BORDER_RATIO = "common_border_ratio"
