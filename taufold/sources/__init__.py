"""Readers, stage tables, artifacts and model stores."""
