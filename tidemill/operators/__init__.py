"""Operators over DataFrames: cleaning, replay, windows, history, serving, verification, measurement, model."""
