"""Whole jobs, from raw tables to published panels, built from the operators."""
