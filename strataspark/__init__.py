"""strataspark: planar-facet analytics over 3-D point clouds, declared as Spark plans."""

__all__ = ["__version__"]
__version__ = "0.1.0"
