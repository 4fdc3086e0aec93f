"""scanforge: PySpark-native analytics for terrestrial laser scans and the rasters made from them."""

__version__ = "0.1.0"
