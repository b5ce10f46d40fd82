"""streaming of strataspark."""
