"""Scalar functions as Catalyst expressions, and the few that need Python."""
