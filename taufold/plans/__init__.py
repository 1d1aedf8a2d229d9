"""Chains of operators: preparation, estimation, validation."""
