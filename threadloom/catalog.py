"""Table catalogue: columns, keys and which source feeds which table.

The catalogue is data. Pass another ``Catalog`` to load other columns or tables.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import types as T

# Column names and types of the normalised tables, in the order of the target schema.
COLUMNS: dict[str, str] = {
    "post": (
        "id string, name string, allow_live_comments boolean, archived boolean, author_fullname string, "
        "author_is_blocked boolean, author_patreon_flair boolean, can_gild boolean, can_mod_post boolean, "
        "category string, content_categories string, contest_mode boolean, created_utc bigint, domain string, "
        "downs bigint, edited boolean, gilded boolean, hidden boolean, hide_score boolean, is_crosspostable "
        "boolean, is_meta boolean, is_original_content boolean, is_reddit_media_domain boolean, "
        "is_robot_indexable boolean, is_self boolean, is_video boolean, locked boolean, media_only boolean, "
        "no_follow boolean, num_comments bigint, num_crossposts bigint, over_18 boolean, permalink string, "
        "pinned boolean, quarantine boolean, saved boolean, score bigint, selftext string, send_replies "
        "boolean, spoiler boolean, stickied boolean, subreddit_id string, subreddit_subscribers bigint, "
        "subreddit_type string, suggested_sort string, title string, total_awards_received bigint, ups "
        "bigint, upvote_ratio double, url string"
    ),
    "distinguished_post": (
        "id string, author_fullname string, distinguished string"
    ),
    "author": (
        "author_fullname string, author string, author_premium boolean"
    ),
    "subreddit": (
        "id string, name string, display_name string, display_name_prefixed string, title string, description "
        "string, public_description string, url string, subreddit_type string, lang string, created_utc "
        "bigint, subscribers bigint, over18 boolean, allow_discovery boolean, allow_galleries boolean, "
        "allow_images boolean, allow_polls boolean, allow_videogifs boolean, allow_videos boolean, "
        "allow_predictions boolean, allow_predictions_tournament boolean, allow_talks boolean, "
        "is_crosspostable_subreddit boolean, community_reviewed boolean, hide_ads boolean, "
        "restrict_commenting boolean, restrict_posting boolean, quarantine boolean, spoilers_enabled boolean, "
        "public_traffic boolean, wiki_enabled boolean, retrieved_on bigint, should_archive_posts boolean, "
        "should_show_media_in_comments_setting boolean, show_media boolean, show_media_preview boolean, "
        "user_flair_enabled_in_sr boolean, user_flair_position string, user_flair_text string, "
        "user_flair_type string, user_sr_theme_enabled boolean, videostream_links_count bigint"
    ),
    "subreddit_metadata": (
        "display_name string, earliest_comment bigint, earliest_post bigint, num_comments bigint, "
        "num_comments_updated_at bigint, num_posts bigint, num_posts_updated_at bigint"
    ),
    "subreddit_settings": (
        "display_name string, accept_followers boolean, accounts_active bigint, accounts_active_is_fuzzed "
        "boolean, advertiser_category string, all_original_content boolean, allow_prediction_contributors "
        "boolean, can_assign_link_flair boolean, can_assign_user_flair boolean, collapse_deleted_comments "
        "boolean, comment_score_hide_mins bigint, disable_contributor_requests boolean, has_menu_widget "
        "boolean, original_content_tag_enabled boolean, prediction_leaderboard_entry_type bigint, "
        "submission_type string, submit_link_label string, submit_text string, submit_text_html string, "
        "submit_text_label string, suggested_comment_sort string, notification_level string"
    ),
    "subreddit_media": (
        "display_name string, banner_background_color string, banner_background_image string, banner_img "
        "string, banner_size string, community_icon string, header_img string, header_size string, "
        "header_title string, icon_img string, icon_size string, key_color string, mobile_banner_image "
        "string, primary_color string"
    ),
    "subreddit_permissions": (
        "display_name string, free_form_reports boolean, link_flair_enabled boolean, link_flair_position "
        "string, user_can_flair_in_sr boolean, user_flair_background_color string, user_flair_css_class "
        "string, user_flair_template_id string, user_flair_text_color string"
    ),
    "subreddit_comment_media": (
        "display_name string, allowed_media_in_comments string"
    ),
    "subreddit_rules": (
        "rule_id string, subreddit string, created_utc bigint, description string, kind string, priority "
        "bigint, short_name string, violation_reason string"
    ),
    "collapsed_comment": (
        "id string, collapsed_reason string, collapsed_reason_code string"
    ),
    "comment": (
        "id string, archived boolean, author_fullname string, author_is_blocked boolean, author_patreon_flair "
        "boolean, body string, can_gild string, can_mod_post string, collapsed string, controversiality "
        "bigint, created_utc bigint, downs bigint, edited boolean, gilded bigint, is_submitter boolean, "
        "link_id string, locked boolean, no_follow boolean, parent_id string, permalink string, score bigint, "
        "score_hidden boolean, send_replies boolean, stickied boolean, subreddit string, subreddit_id string, "
        "subreddit_type string, total_awards_received bigint, ups bigint"
    ),
    "distinguished_comment": (
        "id string, author_fullname string, distinguished string"
    ),
    "wiki": (
        "path string, subreddit string, content string, retrieved_on bigint, revision_date bigint"
    ),
    "revision_wiki": (
        "path string, revision_author string, revision_author_id string, revision_reason string"
    ),
}

# Primary key of each table.
KEYS: dict[str, tuple[str, ...]] = {
    "post": ("name",),
    "distinguished_post": ("id",),
    "author": ("author_fullname",),
    "subreddit": ("display_name",),
    "subreddit_metadata": ("display_name",),
    "subreddit_settings": ("display_name",),
    "subreddit_media": ("display_name",),
    "subreddit_permissions": ("display_name",),
    "subreddit_comment_media": ("display_name",),
    "subreddit_rules": ("rule_id",),
    "collapsed_comment": ("id",),
    "comment": ("id",),
    "distinguished_comment": ("id",),
    "wiki": ("path",),
    "revision_wiki": ("path",),
}

# Foreign keys declared for the tables, in the form the queries join on. They are not enforced.
FOREIGN_KEYS: dict[str, dict[str, str]] = {
    "post": {"author_fullname": "author.author_fullname", "subreddit_id": "subreddit.name"},
    "comment": {"parent_id": "post.name", "link_id": "post.name", "subreddit_id": "subreddit.name"},
    "wiki": {"subreddit": "subreddit.display_name"},
    "subreddit_rules": {"subreddit": "subreddit.display_name"},
}


# Tables that keep the first row of a key, and tables whose key is not a field of the raw record.
FIRST_SEEN = frozenset({"author"})
COMPUTED_KEYS: dict[str, tuple[str, ...]] = {"subreddit_rules": ("subreddit",)}


@dataclass(frozen=True)
class Source:
    """One kind of dump file: the tables it feeds and the collection it is kept in as documents."""

    name: str
    tables: tuple[str, ...]
    collection: str
    # Raw fields a cleaner reads that are not a column of any of the tables.
    extra_fields: tuple[str, ...] = ()


# Source to table mapping.
SOURCES: dict[str, Source] = {
    s.name: s
    for s in (
        Source("submissions", ("post", "author", "distinguished_post"), "post", ("removal_reason", "removed_by")),
        Source("comments", ("comment", "collapsed_comment", "distinguished_comment"), "comment"),
        Source("subreddit_rules", ("subreddit_rules",), "subreddit_rules", ("rules",)),
        Source("subreddit_wikis", ("wiki", "revision_wiki"), "wiki"),
        Source(
            "subreddits",
            (
                "subreddit",
                "subreddit_settings",
                "subreddit_media",
                "subreddit_permissions",
                "subreddit_comment_media",
            ),
            "subreddit",
        ),
        Source("subreddits_meta_only", ("subreddit_metadata",), "subreddit_metadata"),
    )
}


@dataclass(frozen=True)
class Catalog:
    columns: Mapping[str, str] = field(default_factory=lambda: COLUMNS)
    keys: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: KEYS)
    sources: Mapping[str, Source] = field(default_factory=lambda: SOURCES)
    # Tables that keep the first row of a key; in all others a repeated key is an error.
    first_seen: frozenset[str] = FIRST_SEEN
    # Tables whose key is made by their cleaner, with the raw fields that stand for it in whole documents.
    computed_keys: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: COMPUTED_KEYS)

    def schema(self, table: str) -> T.StructType:
        return T.StructType.fromDDL(self.columns[table])

    def key(self, table: str) -> tuple[str, ...]:
        return self.keys[table]

    def document_key(self, collection: str) -> tuple[str, ...]:
        """Raw fields that documents of a collection are laid out by."""
        return self.computed_keys.get(collection, self.keys[collection])

    def raw_fields(self, source: str, tables: Sequence[str] | None = None) -> list[str]:
        """Every raw field the given tables (all of the source by default) can use, keys first."""
        spec = self.sources[source]
        tables = spec.tables if tables is None else tables
        keys = [k for t in tables for k in self.key(t)]
        names = [f.name for t in tables for f in self.schema(t).fields]
        return list(dict.fromkeys([*keys, *names, *spec.extra_fields]))

    def key_width(self, tables: Sequence[str]) -> int:
        return max(len(self.key(t)) for t in tables)


DEFAULT_CATALOG = Catalog()
