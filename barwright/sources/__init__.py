"""Readers and writers of bars, trades, models and requests."""
