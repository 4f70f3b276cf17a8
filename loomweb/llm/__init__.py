"""Operators for preparing training text at corpus scale; see queries.py for the registered queries."""
