"""Column helpers."""

from keyhold.functions.sighting import epoch_micros, sightings

__all__ = ["epoch_micros", "sightings"]
