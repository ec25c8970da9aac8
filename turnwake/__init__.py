"""turnwake: how delay spreads through the daily rotation of shared resources, on Spark."""
