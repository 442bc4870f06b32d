"""papyra.streaming."""
