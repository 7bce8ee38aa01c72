"""Analytics on reads, alignments, intervals and series as Spark plans."""
