"""papyra.plans."""
