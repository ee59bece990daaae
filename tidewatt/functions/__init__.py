"""The metering functions, each defined once as a SQL expression that Catalyst inlines."""

from .library import FUNCTIONS, Function, call, register

__all__ = ["FUNCTIONS", "Function", "call", "register"]
