"""Readers, writers, keyed stores and the covariate source registry."""
