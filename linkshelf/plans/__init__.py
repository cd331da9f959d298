"""Registered queries: every one reads the given tables and has a name, a plan and, where SQL can say it, its SQL."""
