"""Relational operators that Spark has no single primitive for, as DataFrame compositions."""
