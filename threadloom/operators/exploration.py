"""Exploration of raw records: column groups, key prefixes, author counts, example records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: name shown for a deleted account.
DELETED_AUTHOR = "[deleted]"

# Named groups of post attributes; every group also carries ``id``.
COLUMN_GROUPS: dict[str, tuple[str, ...]] = {
    "metadata_keys": ("id", "name", "permalink", "url", "created_utc", "retrieved_on", "_meta.retrieved_2nd_on"),
    "post_content_keys": ("id", "title", "selftext", "domain", "is_self", "is_video", "media", "secure_media"),
    "engagement_keys": ("num_comments", "score", "ups", "downs", "upvote_ratio", "view_count"),
    "author_keys": (
        "author", "author_fullname", "author_premium", "author_flair_text", "author_flair_css_class",
        "author_flair_richtext", "author_flair_background_color", "author_flair_text_color", "author_flair_type",
    ),
    "subreddit_keys": (
        "subreddit", "subreddit_id", "subreddit_name_prefixed", "subreddit_type", "subreddit_subscribers",
    ),
    "moderation_keys": (
        "archived", "locked", "stickied", "removed_by", "removed_by_category", "banned_by", "banned_at_utc",
        "mod_reports", "num_reports", "report_reasons", "removal_reason", "quarantine", "approved_by",
        "approved_at_utc",
    ),
    "awards_flair_keys": (
        "all_awardings", "awarders", "gilded", "total_awards_received", "top_awarded_type", "gildings",
        "link_flair_text", "link_flair_richtext", "link_flair_type", "link_flair_background_color",
        "link_flair_text_color", "link_flair_css_class",
    ),
    "visibility_keys": (
        "over_18", "spoiler", "pinned", "contest_mode", "hide_score", "hidden", "no_follow", "can_gild",
        "can_mod_post", "is_crosspostable", "is_robot_indexable", "is_original_content",
        "is_reddit_media_domain", "is_created_from_ads_ui", "discussion_type", "suggested_sort", "visited",
        "saved", "send_replies", "pwls", "wls", "media_only", "content_categories", "treatment_tags",
    ),
}


def prefixed_columns(df: DataFrame, prefix: str = "author", always: Sequence[str] = ()) -> DataFrame:
    return df.select(*[c for c in df.columns if c in always or c.startswith(prefix)])


def column_groups(
    records: DataFrame, groups: Mapping[str, Sequence[str]] = COLUMN_GROUPS, key: str = "id"
) -> dict[str, DataFrame]:
    """One DataFrame per group with the key and the group's columns that the records have.

    An empty JSON array becomes NULL, other nested values stay as JSON text.
    """
    present = {name: _dropping_empty_array(records, name) for name in records.columns}
    return {
        group: records.select(*[present[c] for c in dict.fromkeys([key, *columns]) if c in present])
        for group, columns in groups.items()
    }


def _dropping_empty_array(records: DataFrame, name: str) -> Column:
    column = F.col(f"`{name}`")
    if records.schema[name].dataType.simpleString() == "string":
        return F.when(column != "[]", column).alias(name)
    return column.alias(name)


def first_with_values(df: DataFrame, array_column: Column, order: Sequence[str]) -> DataFrame:
    """The first row, in the given order, whose array is not empty."""
    return df.filter(F.size(array_column) > 0).orderBy(*order).limit(1)


def not_deleted(df: DataFrame, author: str = "author") -> DataFrame:
    return df.filter(F.col(author) != DELETED_AUTHOR)


def author_counts(df: DataFrame, author: str = "author") -> DataFrame:
    """``unique_authors`` without deleted accounts, and ``deleted_count``.

    Grouped by author first, so the distinct count shuffles one row per author and task.
    """
    per_author = df.groupBy(F.col(author).alias("author")).agg(F.count("*").alias("n"))
    deleted = F.col("author") == DELETED_AUTHOR
    return per_author.agg(
        F.count_if(~deleted).alias("unique_authors"),
        F.coalesce(F.sum(F.when(deleted, F.col("n"))), F.lit(0)).alias("deleted_count"),
    )
