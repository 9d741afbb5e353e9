"""Record linkage and deduplication over catalogues, as Spark plans."""
