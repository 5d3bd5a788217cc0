"""Corpus analytics on Spark: segmentation, linking, editions, quality, search and change detection.

Every public function maps DataFrames to DataFrames or Columns to Columns, so
Catalyst sees whole plans; Python workers appear only for the word alignment,
the pluggable embedding model and the keyed stream state.
"""
