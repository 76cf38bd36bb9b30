"""Spark-native analytics over boxes, tiles, rasters and detections."""
