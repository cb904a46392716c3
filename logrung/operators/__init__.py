"""Keyed and grouped work: ranks, metrics, samples, templates, models."""
