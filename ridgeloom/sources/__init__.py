"""Readers and writers of the text formats: height grids, tracks, JSON tiles. Files are read whole, one row each, by Spark's readers."""
