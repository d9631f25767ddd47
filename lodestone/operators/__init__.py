"""Search operators, the index, the overlay and the engine that joins them."""
