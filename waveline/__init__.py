"""Wavelet synopses and training-data operators on Spark."""
