"""Operators: split candidates, binning, histograms, splits, supervised bins, sampling, private and local quantiles."""
