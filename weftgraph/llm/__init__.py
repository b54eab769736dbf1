"""Operators for preparing training text; nothing else in weftgraph imports this subpackage."""
