"""operators of strataspark."""
