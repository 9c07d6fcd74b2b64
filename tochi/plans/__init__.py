"""Bindings of the given tables, and the registered queries."""

from tochi.plans import catalogue as catalogue
from tochi.plans import runs as runs
