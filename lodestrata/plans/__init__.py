"""Registered queries: importing this package registers them all in ``catalog``."""
