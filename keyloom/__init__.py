"""Spark-native analytics over typed keyspaces: strings, bitmaps, hashes, sets, sorted sets, geo, lists and streams."""
