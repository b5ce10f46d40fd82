"""functions of strataspark."""
