"""sources of strataspark."""
