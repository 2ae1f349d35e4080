"""Spark-native multivariate analysis of spectra and other wide numeric data."""
