"""DataFrame -> DataFrame operators over corpus, state, postings and run tables."""
