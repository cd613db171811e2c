"""Runnable jobs: each reads tables, does one task with the library's operators, and writes tables."""
