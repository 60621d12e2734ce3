"""Composed plans: model evaluation and sweeps, and the registry of checked queries."""
