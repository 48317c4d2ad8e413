"""Query text, prepared queries, batches and the engine that runs them."""
