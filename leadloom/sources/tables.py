"""Snapshot tables that stand for what a live crawl, search or geocoding service would answer.

site_pages(url, status_code, elapsed_ms, html)          crawl snapshot
search_results(company_name, rank, link)                web-search answers
geocodes(raw_location, rank, formatted_address)         geocoding answers
place_search(query, rank, place_id, name, formatted_address)   place text-search answers
places(place_id, name, formatted_address, website_uri, national_phone, international_phone)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Snapshots:
    site_pages: DataFrame | None = None
    search_results: DataFrame | None = None
    geocodes: DataFrame | None = None
    place_search: DataFrame | None = None
    places: DataFrame | None = None
