"""Analytical queries: one function per view or report."""
