"""Data models: relations, configuration, and the engine that builds them."""
