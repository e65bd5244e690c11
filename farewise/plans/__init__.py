"""Composed plans: reports, modelling, multi-report runner."""
