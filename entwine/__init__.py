"""entwine: record linkage over several sources, expressed as Spark plans."""
