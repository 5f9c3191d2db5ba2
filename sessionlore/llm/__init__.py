"""Training-data operators: scoring, filtering, joining, packing and encoding
of document collections. Nothing else in the library imports this package."""
