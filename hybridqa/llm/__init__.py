"""Training-data operators: one module for each, all over a table of documents or pages."""
