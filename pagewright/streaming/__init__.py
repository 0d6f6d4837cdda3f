"""Crawl events: what is due, what is triggered, what is told, and the same over streams."""
