"""Plans: cubes as JSON, and the command line that runs them."""

from .factory import from_json, register

__all__ = ["from_json", "register"]
