"""Native column functions: no Python runs per row."""
