"""Checked queries, their SQL twins and the input tables of checks and benchmarks."""
