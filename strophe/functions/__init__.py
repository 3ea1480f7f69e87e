"""Part of the strophe engine."""
