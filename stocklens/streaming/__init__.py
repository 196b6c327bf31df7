"""Alerts and space use kept current over change feeds."""
