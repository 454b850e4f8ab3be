"""Model monitoring as Spark jobs: drift, quality, fairness, shadow and attribution analysis at scale."""
