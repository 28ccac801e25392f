"""Whole lists: one campaign, or all campaigns of all portfolios in one job."""
