"""Spectral indices, image transforms and gray levels on band arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidParameters
from .bands import band

#: Stands in for a zero divisor.
TINY = 1e-12


def _over(x: Column, y: Column) -> Column:
    return x / F.when(y == 0, TINY).otherwise(y)


def difference_index(a: Column, b: Column) -> Column:
    """``(a - b) / (a + b)`` by pixel, unrounded."""
    return F.zip_with(a, b, lambda x, y: _over(x - y, x + y))


def ratio_index(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, _over)


def awei(green: Column, nir: Column, swir1: Column, swir2: Column) -> Column:
    """Water extraction: ``4 (green - swir1) - (0.25 nir + 2.75 swir2)``."""
    near = F.zip_with(green, swir1, lambda g, s: 4 * (g - s))
    far = F.zip_with(nir, swir2, lambda n, s: 0.25 * n + 2.75 * s)
    return F.zip_with(near, far, lambda x, y: x - y)


#: Index -> the bands it takes, by name.
INDEX_BANDS = {
    "ndwi": ("green", "nir"),
    "mndwi": ("green", "swir1"),
    "ndmi": ("nir", "swir1"),
    "ndvi": ("nir", "red"),
    "ndbi": ("swir1", "nir"),
    "awei": ("green", "nir", "swir1", "swir2"),
    "rvi": ("nir", "red"),
}


def spectral_index(name: str, data: Column, n_bands: Column | int, bands: dict[str, int]) -> Column:
    """One index by pixel; ``bands`` says where each named band is."""
    if name not in INDEX_BANDS:
        raise InvalidParameters(f"no spectral index {name!r}")
    own = [band(data, n_bands, bands[b]) for b in INDEX_BANDS[name]]
    return awei(*own) if name == "awei" else ratio_index(*own) if name == "rvi" else difference_index(*own)


def mean_index(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size(values)


def appended(data: Column, values: Column) -> Column:
    """The raster with one more band."""
    return F.concat(data, values)


def gray(red: Column, green: Column, blue: Column) -> Column:
    """Luminance to the nearest integer (halves to even)."""
    part = F.zip_with(red, green, lambda r, g: 0.299 * r + 0.587 * g)
    return F.zip_with(part, blue, lambda x, b: F.bround(x + 0.114 * b) + 0.0)


def digitized(values: Column, levels: int = 8) -> Column:
    """Values of 0 to 255 in equal levels, from 0."""
    return F.transform(values, lambda v: F.floor(v / (256 / levels)).cast("int"))


def selected_bands(data: Column, n_bands: Column | int, bands: list[int]) -> Column:
    """The raster of some bands, in the order given."""
    return F.flatten(F.array(*(band(data, n_bands, b) for b in bands)))
