"""Training-data operators.

Ten operators for large text corpora plus their queries. Nothing else in the
library imports this subpackage.
"""
