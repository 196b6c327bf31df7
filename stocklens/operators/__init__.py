"""Batch commands, guards, data rules and alert derivation."""
