"""pressmill: a PySpark engine for collections of news-like documents."""
