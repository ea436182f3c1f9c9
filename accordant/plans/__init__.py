"""Whole jobs put together from operators: annotate, reach consensus, filter, build training folds."""
