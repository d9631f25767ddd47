"""Query planning: what a pattern requires, and which documents can hold it."""
