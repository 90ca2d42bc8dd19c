"""Unit conversion of the gridded variables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Variables of the production pipeline, in join order.
GRID_VARIABLES = [
    "pm25",
    "aod550",
    "wind_x",
    "wind_y",
    "dewpoint",
    "temperature",
    "clouds",
    "precipitation",
    "visibility",
]

# Factor and offset per variable. 272.15 is the offset the
# published results were made with; the physical value is 273.15.
KELVIN = 273.15
KELVIN_PARITY = 272.15
MASS_FACTOR = 1e9
DEPTH_FACTOR = 1e3


def convert_units(variable: Column, value: Column, kelvin: float = KELVIN) -> Column:
    """kg to µg for pm25, m to mm for precipitation, K to °C for temperatures."""
    return (
        F.when(variable == "pm25", value * MASS_FACTOR)
        .when(variable == "precipitation", value * DEPTH_FACTOR)
        .when(variable.isin("temperature", "dewpoint"), value - kelvin)
        .otherwise(value)
    )
