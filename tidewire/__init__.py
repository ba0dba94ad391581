"""Signal pre-processing for multichannel time series on Spark."""

__version__ = "0.1.0"
