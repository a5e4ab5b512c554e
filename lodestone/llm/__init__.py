"""Operators for training data: one module for each problem, their queries in ``queries``."""
