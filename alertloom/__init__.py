"""Spark DataFrame operators for operational alerts, incidents and the texts around them."""
from alertloom.settings import Settings

__all__ = ["Settings"]
