"""Wavelet operators on DataFrames: transforms, exact and sampled top-k, reconstruction, error, ids."""
