"""DataFrame operators: lookup, metadata search, full text, ranking, paging and projection."""
