"""Process time-series data sets, forecasts and run tables as Spark jobs."""

from sensorloom.settings import DatasetSpec, Grid, WindowSpec

__all__ = ["DatasetSpec", "Grid", "WindowSpec"]
