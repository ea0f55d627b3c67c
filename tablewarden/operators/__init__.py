"""Running planned checks: the fused aggregation, grouped jobs, samples, keys and profiles."""
