"""Blocking, candidate, feature, metric, training and profiling operators."""
