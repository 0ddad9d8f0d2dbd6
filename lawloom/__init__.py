"""A document-collection engine on PySpark: sources, blocks, chunks, index, retrieval and streams."""
