"""Composed plans: the window as one object, and the registered queries."""

from keyhold.plans.window import KeyWindow

__all__ = ["KeyWindow"]
