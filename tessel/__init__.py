"""Record linkage and fuzzy matching as DataFrame transformations."""
