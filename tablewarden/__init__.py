"""A data-contract engine on Spark: contracts are compiled into one fused aggregation."""

__version__ = "0.1.0"
