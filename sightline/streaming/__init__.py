"""No operator of this library works on a stream; the package is kept for those that will."""
