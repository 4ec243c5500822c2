"""Training-data operators (dedup, licences, quality, tokens, packing, search) as Spark jobs."""
