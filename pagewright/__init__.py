"""Site-audit analytics on PySpark: crawl tables in, issues, scores, keywords and link graphs out."""
