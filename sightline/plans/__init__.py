"""Whole plans: preparation, audit and registered queries."""
