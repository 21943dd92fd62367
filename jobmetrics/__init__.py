"""jobmetrics: latest state, totals, series and lineage of multi-step batch workflow runs, on Spark."""
