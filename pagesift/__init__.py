"""pagesift: evidence analytics over labelled web pages, as PySpark plans."""
