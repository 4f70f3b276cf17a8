"""Technical audits of pages: images, head, accessibility, security, vitals. Findings are rows of codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.dims import VITALS
from .content import heading_structure
from .eligibility import header_values


def _codes(pairs) -> Column:
    """Array of (code, severity, category) whose condition holds."""
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"), F.lit(cat).alias("category"))) for code, sev, cat, c in pairs]), lambda x: x.isNotNull())


def images(parsed: DataFrame) -> DataFrame:
    """One row for each image: format, alt status, dimensions, lazy loading, responsive sources."""
    i = parsed.where("p is not null").select("site", "url", F.explode("p.images").alias("i")).select("site", "url", "i.*")
    ext = F.lower(F.regexp_extract(F.regexp_replace("src", r"[?#].*$", ""), r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(F.col("src").startswith("data:"), "data-uri").when(ext.isin("webp", "avif"), "modern").when(ext.isin("jpg", "jpeg", "png", "gif", "bmp", "tiff"), "legacy").when(ext == "svg", "vector").otherwise("unknown")
    alt = F.when(F.col("alt").isNull(), "MISSING").when(F.trim("alt") == "", "EMPTY_DECORATIVE").otherwise("PRESENT")
    return i.select("site", "url", "pos", "src", kind.alias("format"), alt.alias("alt_status"), (F.col("width").isNotNull() & F.col("height").isNotNull()).alias("sized"), (F.col("loading") == "lazy").alias("lazy"), (F.col("pos") < 2).alias("early"), F.col("srcset").isNotNull().alias("responsive"))


def image_summary(imgs: DataFrame) -> DataFrame:
    n = F.count_if
    return imgs.groupBy("site", "url").agg(
        F.count("*").alias("images"), n(F.col("alt_status") == "MISSING").alias("missing_alt"), n(F.col("alt_status") == "EMPTY_DECORATIVE").alias("empty_alt"), n(~F.col("sized")).alias("unsized"), n("lazy").alias("lazy"),
        n(F.col("lazy") & F.col("early")).alias("lazy_early"), n("responsive").alias("responsive"), n(F.col("format") == "modern").alias("modern"), n(F.col("format") == "legacy").alias("legacy"),
    )


def head_audit(parsed: DataFrame) -> DataFrame:
    """Per page: viewport, language, character set, heading order, and resources over http on an https page."""
    p = parsed.where("p is not null")
    order = p.select("site", "url", "p.*").withColumn("h", heading_structure())
    insecure = F.size(F.filter("resources", lambda r: r["url"].startswith("http://")))
    return order.select("site", "url", (F.coalesce("viewport", F.lit("")) != "").alias("has_viewport"), F.contains(F.lower(F.coalesce("viewport", F.lit(""))), F.lit("user-scalable=no")).alias("zoom_blocked"), (F.coalesce("lang", F.lit("")) != "").alias("has_lang"), F.coalesce("charset", F.lit(False)).alias("has_charset"), "h.valid", F.size("h.skips").alias("heading_skips"), F.when(F.col("url").startswith("https://"), insecure).otherwise(0).alias("insecure_resources"))


def accessibility(parsed: DataFrame) -> DataFrame:
    """site, url, code, severity, category (the WCAG criterion), count of static findings."""
    p = parsed.where("p is not null").select("site", "url", "p.*").withColumn("h", heading_structure())
    dup = F.size("ids") - F.size(F.array_distinct("ids"))
    rules = [
        ("html-has-lang", "SERIOUS", "3.1.1", F.coalesce("lang", F.lit("")) == "", F.lit(1)), ("document-title", "SERIOUS", "2.4.2", F.trim("title") == "", F.lit(1)), ("label", "CRITICAL", "3.3.2", F.col("unlabelled") > 0, F.col("unlabelled")),
        ("landmark-one-main", "MODERATE", "1.3.1", F.col("mains") == 0, F.lit(1)), ("duplicate-id", "MINOR", "4.1.1", dup > 0, dup), ("heading-order", "MODERATE", "1.3.1", F.size("h.skips") > 0, F.size("h.skips")),
        ("link-name", "CRITICAL", "4.1.2", F.col("empty_links") > 0, F.col("empty_links")), ("button-name", "CRITICAL", "4.1.2", F.col("empty_buttons") > 0, F.col("empty_buttons")),
        ("image-alt", "CRITICAL", "1.1.1", F.col("images_without_alt") > 0, F.col("images_without_alt")), ("aria-roles", "SERIOUS", "4.1.2", F.size("bad_roles") > 0, F.size("bad_roles")),
    ]
    rows = F.filter(F.array(*[F.when(cond, F.struct(F.lit(c).alias("code"), F.lit(s).alias("severity"), F.lit(w).alias("category"), n.cast("int").alias("count"))) for c, s, w, cond, n in rules]), lambda x: x.isNotNull())
    return p.select("site", "url", F.explode(rows).alias("f")).select("site", "url", "f.*")


def accessibility_status(findings: DataFrame, pages: DataFrame) -> DataFrame:
    """Per page: tallies and FAIL with critical or serious findings, PARTIAL with others, UNKNOWN without (a static check
    never passes)."""
    n = lambda s: F.count_if(F.col("severity") == s).alias(s.lower())
    t = findings.groupBy("site", "url").agg(n("CRITICAL"), n("SERIOUS"), n("MODERATE"), n("MINOR"))
    out = pages.select("site", "url").distinct().join(t, ["site", "url"], "left").na.fill(0)
    return out.withColumn("status", F.when(F.col("critical") + F.col("serious") > 0, "FAIL").when(F.col("moderate") + F.col("minor") > 0, "PARTIAL").otherwise("UNKNOWN"))


def security(parsed: DataFrame, tls: DataFrame | None = None) -> DataFrame:
    """site, url, code, severity, category of header, cookie, mixed-content and certificate findings.

    tls (site, valid, days_left) is what a handshake said, where one was made.
    """
    h = F.col("response_headers")
    first = lambda name: F.try_element_at(header_values(h, name), F.lit(1))
    has = lambda name: F.size(header_values(h, name)) > 0
    https = F.lower("url").startswith("https://")
    p = parsed
    if tls is not None:
        p = p.join(tls.select("site", "valid", "days_left"), "site", "left")
    else:
        p = p.withColumn("valid", F.lit(None).cast("boolean")).withColumn("days_left", F.lit(None).cast("int"))
    p = p.withColumn("csp", F.lower(F.array_join(header_values(h, "content-security-policy"), ";"))).withColumn("hsts", first("strict-transport-security")).withColumn("xfo", F.upper(F.trim(first("x-frame-options"))))
    known = F.size(F.map_keys(h)) > 0
    age = F.regexp_extract("hsts", r"(?i)max-age\s*=\s*\"?(\d{1,18})", 1).try_cast("bigint")
    cookies = header_values(h, "set-cookie")
    lacks = lambda pattern: F.exists(cookies, lambda c: ~c.rlike(pattern))
    mixed = lambda *tags: F.exists("p.resources", lambda r: r["tag"].isin(*tags) & r["url"].startswith("http://"))
    best, hole = "best_practice", "security_vulnerability"
    rules = [
        ("SEC_HSTS_MISSING", "HIGH", hole, known & https & F.col("hsts").isNull()), ("SEC_HSTS_SHORT_MAX_AGE", "MEDIUM", best, https & (age < 31536000)), ("SEC_CSP_MISSING", "HIGH", hole, known & ~has("content-security-policy")),
        ("SEC_CSP_UNSAFE_INLINE", "MEDIUM", hole, F.contains("csp", F.lit("unsafe-inline")) & ~F.col("csp").rlike("nonce-|sha256-|sha384-|sha512-")),
        ("SEC_X_FRAME_OPTIONS_MISSING", "MEDIUM", hole, known & F.col("xfo").isNull() & ~F.contains("csp", F.lit("frame-ancestors"))), ("SEC_X_FRAME_OPTIONS_INVALID", "LOW", best, ~F.col("xfo").isin("DENY", "SAMEORIGIN")),
        ("SEC_X_CONTENT_TYPE_OPTIONS_MISSING", "LOW", best, known & (F.coalesce(F.lower(F.trim(first("x-content-type-options"))), F.lit("")) != "nosniff")), ("SEC_REFERRER_POLICY_MISSING", "LOW", best, known & ~has("referrer-policy")),
        ("SEC_PERMISSIONS_POLICY_MISSING", "LOW", best, known & ~has("permissions-policy")), ("SEC_SERVER_HEADER_VERSION_LEAK", "LOW", hole, first("server").rlike(r"[\d.]")), ("SEC_X_POWERED_BY_LEAK", "LOW", hole, has("x-powered-by")),
        ("SEC_COOKIE_INSECURE", "HIGH", hole, https & lacks(r"(?i);\s*secure\b")), ("SEC_COOKIE_NO_HTTPONLY", "MEDIUM", hole, lacks(r"(?i);\s*httponly\b")), ("SEC_COOKIE_NO_SAMESITE", "LOW", best, lacks(r"(?i);\s*samesite\s*=")),
        ("SEC_ACTIVE_MIXED_CONTENT", "CRITICAL", hole, https & mixed("script", "style", "iframe", "object")), ("SEC_PASSIVE_MIXED_CONTENT", "MEDIUM", best, https & mixed("img", "audio", "video", "source")),
        ("SEC_TLS_INVALID", "CRITICAL", hole, ~F.col("valid")), ("SEC_TLS_EXPIRED", "CRITICAL", hole, F.col("days_left") < 0), ("SEC_TLS_EXPIRING_SOON", "MEDIUM", best, F.col("days_left").between(0, 29)),
    ]
    return p.select("site", "url", F.explode(_codes(rules)).alias("f")).select("site", "url", "f.*")


def security_status(findings: DataFrame, crawl: DataFrame) -> DataFrame:
    """Per page: tallies and FAIL, PARTIAL, PASS or UNAVAILABLE."""
    n = lambda s: F.count_if(F.col("severity") == s).alias(s.lower())
    t = findings.groupBy("site", "url").agg(n("CRITICAL"), n("HIGH"), n("MEDIUM"), n("LOW"))
    out = crawl.select("site", "url", (F.size(F.map_keys("response_headers")) > 0).alias("known")).join(t, ["site", "url"], "left").na.fill(0)
    bad = (F.col("critical") + F.col("high") > 0) | ~F.lower("url").startswith("https://")
    return out.withColumn("status", F.when(bad, "FAIL").when(F.col("medium") + F.col("low") > 0, "PARTIAL").when(F.col("known"), "PASS").otherwise("UNAVAILABLE"))


def tally(findings: DataFrame) -> DataFrame:
    """Findings of each site by code and severity."""
    return findings.groupBy("site", "code", "severity").agg(F.count("*").alias("pages"))


def band(metric: Column, value: Column) -> Column:
    """GOOD, NEEDS_IMPROVEMENT or POOR by the metric's thresholds; null for others."""
    out = F.lit(None).cast("string")
    for name, good, poor, _ in VITALS:
        out = F.when(metric == name, F.when(value <= good, "GOOD").when(value <= poor, "NEEDS_IMPROVEMENT").otherwise("POOR")).otherwise(out)
    return F.when(value.isNotNull(), out)


def local_speed(samples: DataFrame) -> DataFrame:
    """site, ttfb_s, score of timed answers (site, seconds): 85 up to 0.8 s on average, 65 up to 1.8, else 35."""
    t = samples.groupBy("site").agg(F.avg("seconds").alias("ttfb_s"))
    return t.withColumn("score", F.when(F.col("ttfb_s") <= 0.8, 85).when(F.col("ttfb_s") <= 1.8, 65).otherwise(35))


def external_hosts(parsed: DataFrame) -> DataFrame:
    """site, url, host of links that leave the site."""
    l = parsed.where("p is not null").select("site", "url", F.explode("p.links").alias("l")).select("site", "url", F.regexp_replace(urls.host(F.col("l.href")), "^www\\.", "").alias("host"))
    return l.where("host <> ''").where(F.col("host") != F.regexp_replace("site", "^www\\.", ""))
