"""papyra.functions."""
