"""lexmill: searching, analysing and preparing collections of text documents with PySpark."""
