"""Scalar functions of the two planes, as columns."""
