"""A PySpark-native engine for tiled raster analytics."""
