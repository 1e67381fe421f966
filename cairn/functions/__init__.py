"""Scalar functions and syntax of the dialect that Spark spells differently."""
