"""Operators over series: windows, joins in time, folds, signals, factors."""
