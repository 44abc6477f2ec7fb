"""Importing this registers all functions."""

from lumenpath.functions import aggregates, conversion, existence, mathematics, navigation, strings, temporals  # noqa: F401
