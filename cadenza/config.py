"""Thresholds of the analyses, as one immutable set that callers may replace."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    tick_seconds: int = 5
    month_seconds: int = 30 * 86400
    day_seconds: int = 86400
    week_seconds: int = 7 * 86400
    last_month: int = 23
    skip_below: int = 30
    full_from: int = 80
    top_artists: int = 15
    session_gap: int = 30 * 60
    uid_mod: int = 10
    # co-likes: largest number of items a user may have, least weight of an edge, nodes shown
    like_items: int = 30
    like_item_weight: int = 3
    like_artists: int = 50
    like_artist_weight: int = 15
    like_top_items: int = 200
    like_top_artists: int = 120
    # co-listening
    listen_popular_items: int = 10
    listen_items: int = 300
    listen_item_weight: int = 5
    listen_popular_artists: int = 30
    listen_artists: int = 250
    listen_artist_weight: int = 12
    listen_top_items: int = 150
    listen_top_artists: int = 100
    listen_users: int = 5_000
    edge_limit: int = 500_000
    few_popular: int = 50
    few_rows: int = 1_000
    few_edges: int = 50
    entropy_least: int = 10
    lifecycle_days: int = 14
    churn_days: int = 30
    churn_least: int = 50
    churn_users: int = 90_000
    high_correlation: float = 0.85
    frame_limit_gb: float = 2.0
    least_file_bytes: int = 1024


DEFAULT = Settings()
