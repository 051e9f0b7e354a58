"""Fitted detectors and models on unbounded input."""
