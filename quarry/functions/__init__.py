"""Scalar functions as Column expressions; ``call(name, ...)`` finds them by any of their names."""

from . import conditional, datetime, geo, numeric, string
from .base import REGISTRY, call

__all__ = ["REGISTRY", "call", "conditional", "datetime", "geo", "numeric", "string"]
