"""Document analytics on Spark: office documents and tables as cells, blocks, pages, slides and charts."""
