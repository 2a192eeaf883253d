"""Lead-data engine on Spark: read, map, deduplicate, enrich, resolve, grade, score and analyse leads."""
