"""papyra.operators."""
