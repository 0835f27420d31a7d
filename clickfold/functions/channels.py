"""Default channel grouping: an ordered rule list, first hit wins.

The rules are data (RULES); the test oracle states them on its own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clickfold.functions._cache import per_context

# --- fixed values: channel rule patterns, lists and order -------------------
# Patterns are partial-match regular expressions over the raw text.
SHOPPING_SOURCES = "alibaba|amazon|google shopping|shopify|etsy|ebay|stripe|walmart"
SHOPPING_CAMPAIGN = "^(.*(([^a-df-z]|^)shop|shopping).*)$"
PAID_MEDIUM = "^(.*cp.*|ppc|paid.*)$"
SEARCH_SOURCES = "baidu|bing|duckduckgo|ecosia|google|yahoo|yandex"
SOCIAL_SOURCES = "badoo|facebook|fb|instagram|linkedin|pinterest|tiktok|twitter|whatsapp"
VIDEO_SOURCES = "dailymotion|disneyplus|netflix|youtube|vimeo|twitch|vimeo|youtube"
VIDEO_MEDIUM = "^(.*video.*)$"
EMAIL_PATTERN = "email|e-mail|e_mail|e mail"
CROSS_NETWORK = "cross-network"
PUSH_MEDIUM_SUFFIX = "%push"
PUSH_MEDIUM = "mobile|notification"
DIRECT_SOURCE = "(direct)"
DIRECT_MEDIUMS = ("(not set)", "(none)")
DISPLAY_MEDIUMS = ("display", "banner", "expandable", "interstitial", "cpm")
SOCIAL_MEDIUMS = ("social", "social-network", "social-media", "sm", "social network", "social media")
FALLBACK = "Unassigned"

# Conditions: ("re", field, pattern) partial match, ("in", field, values),
# ("eq", field, value), ("like", field, pattern), ("and"|"or", cond, cond...).
_SHOPPING = ("or", ("re", "source", SHOPPING_SOURCES), ("re", "campaign", SHOPPING_CAMPAIGN))
_PAID = ("re", "medium", PAID_MEDIUM)
RULES = [
    ("Direct", ("and", ("eq", "source", DIRECT_SOURCE), ("in", "medium", DIRECT_MEDIUMS))),
    ("Cross-network", ("re", "campaign", CROSS_NETWORK)),
    ("Paid Shopping", ("and", _SHOPPING, _PAID)),
    ("Paid Search", ("and", ("re", "source", SEARCH_SOURCES), _PAID)),
    ("Paid Social", ("and", ("re", "source", SOCIAL_SOURCES), _PAID)),
    ("Paid Video", ("and", ("re", "source", VIDEO_SOURCES), _PAID)),
    ("Display", ("in", "medium", DISPLAY_MEDIUMS)),
    ("Organic Shopping", _SHOPPING),
    ("Organic Social", ("or", ("re", "source", SOCIAL_SOURCES), ("in", "medium", SOCIAL_MEDIUMS))),
    ("Organic Video", ("or", ("re", "source", VIDEO_SOURCES), ("re", "medium", VIDEO_MEDIUM))),
    ("Organic Search", ("or", ("re", "source", SEARCH_SOURCES), ("eq", "medium", "organic"))),
    ("Email", ("or", ("re", "source", EMAIL_PATTERN), ("re", "medium", EMAIL_PATTERN))),
    ("Affiliates", ("eq", "medium", "affiliate")),
    ("Referral", ("eq", "medium", "referral")),
    ("Audio", ("eq", "medium", "audio")),
    ("SMS", ("eq", "medium", "sms")),
    ("Mobile Push Notifications", ("or", ("like", "medium", PUSH_MEDIUM_SUFFIX), ("re", "medium", PUSH_MEDIUM))),
]
# ---------------------------------------------------------------------------
CHANNELS = [name for name, _ in RULES] + [FALLBACK]


def java_pattern(pattern: str) -> str:
    """The rules' `$` matches only at the very end of the text (`\\z`); Java's
    also matches before a final line break. Their `.` stops at "\\n" alone
    (`(?d)`); Java's also at "\\r", U+0085, U+2028 and U+2029."""
    return "(?d)" + (pattern[:-1] + r"\z" if pattern.endswith("$") else pattern)


def _column(cond, cols: dict[str, Column]) -> Column:
    op = cond[0]
    if op in ("and", "or"):
        parts = [_column(c, cols) for c in cond[1:]]
        out = parts[0]
        for p in parts[1:]:
            out = (out & p) if op == "and" else (out | p)
        return out
    col, arg = cols[cond[1]], cond[2]
    if op == "re":
        return col.rlike(java_pattern(arg))
    if op == "in":
        return col.isin(*arg)
    if op == "eq":
        return col == F.lit(arg)
    if op == "like":
        return col.like(arg)
    raise ValueError(op)


@per_context
def channel_group(source: Column | str, medium: Column | str, campaign: Column | str) -> Column:
    """One of CHANNELS for a (source, medium, campaign) triple."""
    cols = {
        k: (F.col(v) if isinstance(v, str) else v)
        for k, v in (("source", source), ("medium", medium), ("campaign", campaign))
    }
    expr = None
    for name, cond in RULES:
        c = _column(cond, cols)
        expr = F.when(c, F.lit(name)) if expr is None else expr.when(c, F.lit(name))
    return expr.otherwise(F.lit(FALLBACK))
