"""DataFrame in, DataFrame out. Every operator takes its key columns, so it serves many series at once."""
