"""Table schemas, declared and never inferred."""

from __future__ import annotations

LINK = "struct<href: string, text: string, rel: string, nofollow: boolean>"
OUTLINK = "struct<href: string, text: string, rel: string, nofollow: boolean, status_code: int, is_broken: boolean, redirect_chain: array<string>, error: string>"
IMAGE = "struct<src: string, alt: string, width: int, height: int>"
ALTERNATE = "struct<lang: string, href: string>"

PAGE = f"""page_id string, project_id string, url string, canonical_url string, status_code int, response_time double,
title string, meta_description string, meta_robots string, h1 array<string>, h2 array<string>, h3 array<string>,
h4 array<string>, h5 array<string>, h6 array<string>, og_tags map<string, string>, json_ld array<string>,
internal_links array<{LINK}>, external_links array<{OUTLINK}>, images array<{IMAGE}>, word_count int,
hreflang_tags array<{ALTERNATE}>, page_size int, depth int, last_crawled_at timestamp"""
CRAWL = """crawl_id string, project_id string, status string, created_at timestamp, started_at timestamp,
completed_at timestamp, total_pages int, new_pages int, removed_pages int, changed_pages int, error_count int, diff string"""
CRAWL_PAGE = "crawl_id string, page_id string"
DETECTED = "rule_id string, category string, severity string, affected_url string, page_id string, evidence string"
ISSUE = """issue_id string, project_id string, rule_id string, category string, severity string, affected_url string,
page_id string, evidence string, title string, description string, is_whitelisted boolean, whitelist_reason string,
status string, first_detected_at timestamp, last_detected_at timestamp, resolved_at timestamp"""
WHITELIST = "project_id string, scope string, issue_id string, rule_id string, url_pattern string, reason string, expires_at timestamp"
KEYWORD = "page_id string, keyword string, score double, frequency int, sources array<string>"
NODE = """node_id string, page_id string, url string, label string, grp string, depth int, issue_count int,
inbound_links int, status string, is_new boolean, is_removed boolean"""
EDGE = "source_node_id string, target_node_id string, anchor_text string, is_new boolean"
ROBOTS_RULE = "group_ix int, user_agent string, kind string, pattern string"
LINK_STATUS = "href string, status_code int, is_broken boolean, redirect_chain array<string>, error string"
AGENT = """agent_id string, project_id string, trigger_type string, trigger_config string, is_active boolean,
created_at timestamp, last_run_at timestamp, last_run_status string"""
