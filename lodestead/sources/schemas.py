"""Explicit schemas: readers never infer."""

from __future__ import annotations

LISTING = """id bigint, external_id string, source string, property_type string, transaction_type string, title string,
description string, price double, currency string, price_note string, address string, city string, district string,
region string, latitude double, longitude double, size_m2 double, layout string, floor int, total_floors int,
condition string, construction string, ownership string, furnishing string, energy_rating string, amenities string,
image_urls array<string>, thumbnail_url string, source_url string, listed_at timestamp_ntz, scraped_at timestamp_ntz,
enriched_at timestamp_ntz, last_checked_at timestamp_ntz, last_image_checked_at timestamp_ntz, created_at timestamp_ntz,
deactivated_at timestamp_ntz, deactivation_reason string, is_active boolean, is_canonical boolean, cluster_id string,
seller_name string, seller_phone string, seller_email string, seller_company string, additional_params map<string,string>"""

WATCHDOG = """id bigint, email string, email_canonical string, filters struct<property_type:string,transaction_type:string,
city:string,region:string,source:string,layout:string,condition:string,construction:string,ownership:string,furnishing:string,
energy_rating:string,amenities:string,location:string,price_min:double,price_max:double,size_min:double,size_max:double,
sw_lat:double,sw_lng:double,ne_lat:double,ne_lng:double>, label string, active boolean,
created_at timestamp_ntz, last_notified_at timestamp_ntz, deleted_at timestamp_ntz"""

NOTIFICATION = "email_canonical string, cluster_key string, sent_at timestamp_ntz"

RUN = "id bigint, source string, started_at timestamp_ntz, finished_at timestamp_ntz, new_count bigint, updated_count bigint, error_count bigint, status string"

#: The enumerations of the data model.
PROPERTY_TYPES = ("flat", "house", "land", "commercial", "garage", "cottage", "residential_building", "other")
TRANSACTION_TYPES = ("rent", "sale", "auction", "flatshare")
SORTS = ("newest", "price_asc", "price_desc", "size_asc", "size_desc")
CONDITIONS = ("new", "very_good", "good", "after_reconstruction", "before_reconstruction", "under_construction", "project", "poor", "demolition")
EXACT_FILTERS = ("property_type", "transaction_type", "city", "region", "source", "layout", "condition", "construction", "ownership", "furnishing", "energy_rating")
#: Bounds of the numbers in a stored search.
MOST = float("inf")
BOUNDS = {"price_min": (0.0, MOST), "price_max": (0.0, MOST), "size_min": (0.0, MOST), "size_max": (0.0, MOST), "sw_lat": (-90.0, 90.0), "sw_lng": (-180.0, 180.0), "ne_lat": (-90.0, 90.0), "ne_lng": (-180.0, 180.0)}
