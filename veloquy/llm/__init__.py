"""Operators that prepare training text. Nothing else in the package imports this one."""
