"""Whole plans: the standard pipeline and the registered queries."""
