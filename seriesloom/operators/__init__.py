"""DataFrame -> DataFrame building blocks, all keyed by series columns plus a time column."""
