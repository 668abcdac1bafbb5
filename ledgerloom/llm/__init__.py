"""Operators for text and record-linkage problems of training-data pipelines."""
