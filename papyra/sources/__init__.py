"""papyra.sources."""
