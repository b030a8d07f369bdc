"""Where window contents are kept."""

from keyhold.sources.folder import register as register_folder
from keyhold.sources.state import StaleWindowError, load_state, save_state

__all__ = ["StaleWindowError", "load_state", "register_folder", "save_state"]
