"""Lists as files."""
