"""Review analytics over text and source collections, expressed as DataFrame, SQL and streaming plans."""
