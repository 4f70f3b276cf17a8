"""Registries: small dimension tables of public facts and thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Query parameters that only track visitors.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "msclkid", "mc_eid", "_ga", "_gl")
# Path endings that are not pages.
BINARY = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".ico", ".bmp", ".tiff", ".pdf", ".zip", ".tar", ".gz", ".rar", ".7z", ".mp3", ".mp4", ".wav", ".avi", ".mov", ".mkv", ".webm", ".css", ".js", ".mjs", ".woff", ".woff2", ".ttf", ".eot", ".otf", ".exe", ".dmg", ".apk", ".bin")
# Anchor texts that say nothing of their target.
GENERIC_ANCHORS = ("click here", "click", "here", "read more", "learn more", "view more", "see more", "more", "more info", "more details", "details", "link", "page", "this page", "website", "source", "continue", "continue reading", "download", "get started", "find out more", "check it out", "go here", "view", "read", "open", "know more")
# Endings and hosts that count as authorities, and social networks.
AUTHORITY_TLDS = (".edu", ".gov", ".org", ".nic.in", ".gov.in")
AUTHORITY_DOMAINS = ("wikipedia.org", "pubmed.ncbi.nlm.nih.gov", "ncbi.nlm.nih.gov", "scholar.google.com", "nature.com", "sciencedirect.com", "arxiv.org", "who.int", "cdc.gov", "doi.org", "ieee.org", "acm.org", "wikidata.org", "bis.gov.in", "iso.org")
SOCIAL_DOMAINS = ("twitter.com", "x.com", "instagram.com", "facebook.com", "linkedin.com", "youtube.com", "github.com", "pinterest.com", "reddit.com")
# Lengths of titles and descriptions, least words by kind of page, structured data with and without rich results.
TITLE_LENGTH, DESCRIPTION_LENGTH = (30, 65), (110, 165)
WORD_MINIMUMS = {"homepage": 500, "service_page": 800, "location_page": 600, "blog_article": 1200, "product_page": 350}
ACTIVE_SCHEMAS = ("Organization", "Product", "Article", "NewsArticle", "LocalBusiness", "ProfessionalService", "SoftwareApplication", "WebSite", "BreadcrumbList", "VideoObject", "ProfilePage")
RETIRED_SCHEMAS = ("FAQPage", "HowTo", "SpecialAnnouncement", "VehicleListing")
# Vitals as (metric, good up to, needs improvement up to, unit).
VITALS = (("LCP", 2.5, 4.0, "s"), ("INP", 200.0, 500.0, "ms"), ("CLS", 0.1, 0.25, "score"), ("TTFB", 0.8, 1.8, "s"))
# Public crawlers as (agent, category, company, purpose, priority).
BOTS = (
    ("Googlebot", "search_engine", "Google", "search_index", "CRITICAL"),
    ("Bingbot", "search_engine", "Microsoft", "search_index", "CRITICAL"),
    ("Slurp", "search_engine", "Yahoo", "search_index", "MEDIUM"),
    ("DuckDuckBot", "search_engine", "DuckDuckGo", "search_index", "MEDIUM"),
    ("YandexBot", "search_engine", "Yandex", "search_index", "MEDIUM"),
    ("Baiduspider", "search_engine", "Baidu", "search_index", "LOW"),
    ("OAI-SearchBot", "ai_search", "OpenAI", "search_index", "CRITICAL"),
    ("PerplexityBot", "ai_search", "Perplexity", "search_index", "HIGH"),
    ("Claude-SearchBot", "ai_search", "Anthropic", "search_index", "HIGH"),
    ("ChatGPT-User", "ai_search", "OpenAI", "user_fetch", "HIGH"),
    ("Perplexity-User", "ai_search", "Perplexity", "user_fetch", "MEDIUM"),
    ("Claude-User", "ai_search", "Anthropic", "user_fetch", "MEDIUM"),
    ("GPTBot", "ai_training", "OpenAI", "ai_training", "MEDIUM"),
    ("ClaudeBot", "ai_training", "Anthropic", "ai_training", "MEDIUM"),
    ("Google-Extended", "ai_training", "Google", "ai_training", "MEDIUM"),
    ("Applebot-Extended", "ai_training", "Apple", "ai_training", "LOW"),
    ("CCBot", "ai_training", "Common Crawl", "ai_training", "LOW"),
    ("FacebookBot", "ai_training", "Meta", "ai_training", "LOW"),
    ("cohere-ai", "ai_training", "Cohere", "ai_training", "LOW"),
    ("Bytespider", "ai_training", "ByteDance", "ai_training", "LOW"),
    ("Applebot", "platform", "Apple", "search_index", "MEDIUM"),
)
# English function words.
STOPWORDS = tuple(
    """a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself
    just me more most my myself no nor not now of off on once only or other our ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who
    whom why will with would you your yours yourself yourselves""".split()
)


def bots(spark: SparkSession) -> DataFrame:
    """agent, category, company, purpose, priority of the known crawlers."""
    return spark.createDataFrame(list(BOTS), "agent string, category string, company string, purpose string, priority string")


def bot_info(spark: SparkSession, agent: str) -> DataFrame:
    """The registry's row of one crawler, by its exact name; none if it isn't known."""
    return bots(spark).where(bots(spark).agent == agent)


def vitals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(VITALS), "metric string, good double, poor_from double, unit string")
