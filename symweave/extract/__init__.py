"""Source text to symbols, containment and references."""
