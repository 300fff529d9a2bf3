"""Schemas of the tables that the operators take, as DDL text."""

from __future__ import annotations


PRODUCTS = "product_id bigint, name string, brand string, category string, size string, currency string, is_demo boolean, last_checked_at timestamp"
RETAILERS = "retailer_id bigint, retailer_name string, domain string, is_own_store boolean, is_brand_store boolean"
SOURCES = "source_id bigint, product_id bigint, retailer_id bigint, url string, is_own_store boolean, sort_order int, scraping_status string, last_error string, last_scraped_at timestamp"
OBSERVATIONS = "source_id bigint, product_id bigint, retailer_id bigint, price double, original_price double, currency string, availability string, scraped_at timestamp, order_key bigint, order_line int"
