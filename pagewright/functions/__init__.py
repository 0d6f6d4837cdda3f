"""Column functions: text, urls, json-ld, cron."""
