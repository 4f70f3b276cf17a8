"""Whole audits as named tables: what a crawl, a page or a cohort of sites gives.

An audit is a dict of DataFrames, each computed when it is read. The parsed pages are settled once, since most tables
need them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dims, urls
from ..operators import answers, chains, cohort, content, crawl, eligibility, entities, graph, links, scores, search, technical
from ..sources import parse, robots, sitemaps
from ..sources import crawl as source
from . import reports
from .shared import settle


def audit(
    records: DataFrame, robots_txt: DataFrame | None = None, sitemap_documents: DataFrame | None = None, rendered: DataFrame | None = None, tls: DataFrame | None = None, telemetry: DataFrame | None = None,
    llms_txt: DataFrame | None = None, timings: DataFrame | None = None, keywords: DataFrame | None = None, cited: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All tables of a crawl (a table as of sources.crawl); robots_txt (site, status_code, content), sitemap_documents (site,
    sitemap, status_code, body), rendered (site, url, raw_html), tls, telemetry, llms_txt (site, content; a row a file
    found), timings (site, seconds), keywords (site, traffic) and cited (site, id, url, text) add what they know."""
    spark = records.sparkSession
    static = None
    if rendered is not None:
        static = parse.parse_pages(records.join(rendered.select("url").distinct(), "url", "left_semi")).select("site", "url", F.col("p").alias("static"))
        records = source.primary_html(records, rendered)
    parsed = settle(parse.parse_pages(records))
    good = parsed.where("status_code = 200 and p is not null")
    link = settle(links.extract_links(good, crawl=records))
    nodes, edges = graph.link_graph(records, link)
    nodes = settle(nodes)
    body = settle(content.page_content(good))
    ents = settle(entities.page_entities(good))
    sig = settle(search.signals(good, ents))
    topics = settle(search.page_topics(search.topic_members(sig)))
    concept = settle(search.concepts(sig, topics, good))
    intent = settle(search.intents(search.intent_evidence(good), good))
    units = settle(answers.answer_units(good))
    redirects = settle(chains.redirect_chains(records))
    canonicals = settle(chains.canonical_chains(records, eligibility.canonical_of(good), redirects))
    paths = parsed.select("site", F.regexp_replace("url", "^[A-Za-z]+://[^/?#]*", "").alias("path")).withColumn("path", F.when(F.col("path") == "", "/").otherwise(F.col("path")))
    bots = dims.bots(spark)
    matrix = robots.bot_matrix(robots_txt, paths, bots) if robots_txt is not None else paths.limit(0).select("site", "path", F.lit("").alias("agent"), F.lit("").alias("status"))
    maps = None
    if sitemap_documents is not None:
        roots = robots.sitemaps_of(robots_txt) if robots_txt is not None else sitemap_documents.select("site", "sitemap")
        maps = settle(sitemaps.sitemap_urls(sitemaps.traverse(roots, sitemap_documents)))
    allowed = robots.allowed_pages(records, robots_txt) if robots_txt is not None else None
    fit = settle(eligibility.eligibility(parsed, maps, link, allowed, telemetry))
    barriers = answers.waf(records)
    broken, unclear = links.broken_links(link, records), links.ambiguous_anchors(link)
    grounded = answers.ground_claims(answers.claims(good, units), answers.passages(good, units, evidence=True))
    findings, access = technical.security(parsed, tls), technical.accessibility(good)
    cite = settle(scores.citability(good))
    trust = scores.trust(good, cite)
    score = scores.technical_score(good).join(cite, ["site", "url"]).join(trust, ["site", "url"])
    score = _outside(score, timings, keywords).select("site", "url", "technical_score", "citability", "trust", "grade", "performance", "keyword")
    health = settle(scores.health(score))
    assets, agents = answers.visual_assets(good), answers.agent_surfaces(good)
    flags = settle(_flags(good, fit, barriers, link, ents, topics, units, grounded, findings, access, body, trust, cite, assets))
    flags = settle(_site_flags(flags, good, matrix, robots_txt, llms_txt, timings, cited))
    pages = good.select("site", "url", "p")
    both = pages.withColumn("rendered", F.lit(None).cast(pages.schema["p"].dataType)) if static is None else pages.join(static, ["site", "url"], "left").select("site", "url", F.coalesce("static", "p").alias("p"), F.when(F.col("static").isNotNull(), F.col("p")).alias("rendered"))
    contradictions = settle(scores.conflicts(both.join(flags, ["site", "url"], "left")))
    severe = contradictions.where("severity in ('HIGH', 'CRITICAL')").groupBy("site", "url").agg(F.count("*").alias("conflicts"))
    wide = good.join(flags, ["site", "url"], "left").join(severe, ["site", "url"], "left")
    reach = answers.retrieval(fit, barriers, matrix, bots)
    out = {
        "rollup": crawl.rollup(parsed), "page_issues": crawl.page_issues(parsed), "links": link, "link_evidence": links.link_evidence(link), "anchors": links.anchor_summary(link), "generic_anchors": links.generic_anchors(link), "ambiguous_anchors": unclear, "broken_links": broken,
        "graph_nodes": nodes, "graph_edges": edges, "graph_summary": graph.graph_summary(nodes, edges, graph.weak_components(nodes, edges), graph.strong_components(nodes, edges)), "link_findings": links.structural_findings(nodes, broken, unclear), "page_links": links.page_link_records(nodes, edges, link), "concentration": links.concentration(nodes, link),
        "content": body, "site_content": content.site_content(body), "exact_duplicates": content.exact_duplicates(body), "near_duplicates": content.near_duplicates(body), "boilerplate": content.boilerplate(body),
        "redirect_chains": redirects, "canonical_chains": canonicals, "representations": eligibility.representations(parsed), "eligibility": fit, "bot_matrix": matrix,
        "entities": ents, "entity_profiles": entities.entity_profiles(ents), "entity_relations": entities.entity_relations(ents), "primary_organization": entities.primary_organization(ents), "structured_visible": entities.structured_visible(ents),
        "signals": search.ranked_signals(sig), "recurring": search.recurring(sig), "topics": topics, "topic_relations": search.site_relations(search.topic_relations(topics)), "site_topics": search.site_topics(topics), "concepts": concept, "concept_pages": search.concept_pages(concept),
        "intents": intent, "coverage": search.coverage(concept, topics, intent), "cannibalization": search.cannibalization(concept, topics, good, intent), "topic_gaps": search.topic_gaps(concept, topics).union(search.depth_gaps(concept, topics, good)),
        "retrieval": reach, "snippets": answers.snippet_controls(parsed), "barriers": barriers, "answer_units": units, "clarity": answers.clarity(good, units), "topic_answers": answers.topic_answers(topics, units), "claims": grounded,
        "surfaces": answers.surfaces(good, ents), "structured_fields": answers.structured_fields(good, ents), "visual_assets": assets, "agent_surfaces": agents, "access_paths": answers.access_paths(units, assets, agents),
        "images": technical.image_summary(technical.images(good)), "head": technical.head_audit(good), "accessibility": access, "accessibility_status": technical.accessibility_status(access, good), "security": findings, "security_status": technical.security_status(findings, records),
        "citability": cite, "trust": trust, "health": health, "conflicts": contradictions, "provenance": scores.provenance(wide), "actions": scores.actions(wide), "remediations": scores.remediations(wide), "fixes": scores.fixes(good),
        "queries": answers.external_queries(entities.primary_organization(ents), search.site_topics(topics)),
    }
    if maps is not None:
        out["sitemap_urls"] = maps
        out["sitemap_conflicts"] = sitemaps.reconcile(maps, fit, records, nodes, canonicals)
    out["package"] = cohort.site_packages(good, body, units, ents, topics, intent, health, link, assets, agents, access, findings, grounded, reach)
    out["review"] = cohort.reviews(out["package"])
    out["report"] = reports.markdown_lines(health.groupBy("site").agg(*[F.round(F.avg(c), 1).alias(c) for c in ("technical_score", "citability", "trust", "health")]), technical.tally(findings.unionByName(access.drop("count"))), out["actions"])
    return out


def _outside(score: DataFrame, timings: DataFrame | None, keywords: DataFrame | None) -> DataFrame:
    """Scores with performance (of timed answers) and keyword (of search traffic), null where unknown."""
    none = F.lit(None).cast("double")
    speed = technical.local_speed(timings).select("site", F.col("score").cast("double").alias("performance")) if timings is not None else None
    found = keywords.groupBy("site").agg(scores.keyword_score(F.max("traffic")).cast("double").alias("keyword")) if keywords is not None else None
    for name, part in (("performance", speed), ("keyword", found)):
        score = score.withColumn(name, none) if part is None else score.join(part, "site", "left")
    return score


def _site_flags(flags, good, matrix, robots_txt, llms_txt, timings, cited) -> DataFrame:
    """flags with what files, timings and answers from outside add: agents, robots_txt, llms_txt, ttfb_ms, citation_mismatch;
    null where nothing is known."""
    path = F.regexp_replace("url", "^[A-Za-z]+://[^/?#]*", "")
    out = flags.withColumn("path", F.when(path == "", "/").otherwise(path))
    if robots_txt is not None:
        has = robots_txt.groupBy("site").agg(F.max(F.col("status_code") == 200).alias("robots_txt"))
        agents = matrix.groupBy("site", "path").agg(F.map_from_entries(F.collect_list(F.struct("agent", "status"))).alias("agents"))  # a registry's agents: some dozens
        out = out.join(agents.join(has.where("robots_txt").select("site"), "site", "left_semi"), ["site", "path"], "left").join(has, "site", "left").withColumn("robots_txt", F.coalesce("robots_txt", F.lit(False)))
    if llms_txt is not None:
        out = out.join(llms_txt.select("site").distinct().withColumn("llms_txt", F.lit(True)), "site", "left").withColumn("llms_txt", F.coalesce("llms_txt", F.lit(False)))
    if timings is not None:
        out = out.join(technical.local_speed(timings).select("site", (F.col("ttfb_s") * 1000).alias("ttfb_ms")), "site", "left")
    if cited is not None:
        wrong = answers.citations(cited, good).where("match = 'MISMATCH'").groupBy("site", urls.normalise(F.col("url")).alias("normalized_url")).agg(F.count("*").alias("citation_mismatch"))
        out = out.join(good.select("site", "url", "normalized_url").join(wrong, ["site", "normalized_url"]).groupBy("site", "url").agg(F.sum("citation_mismatch").alias("citation_mismatch")), ["site", "url"], "left")
    return out.drop("path")


def _flags(good, fit, barriers, link, ents, topics, units, grounded, findings, access, body, trust, cite, assets) -> DataFrame:
    """One row a page with what conflicts, actions and remediations ask for, without the page itself."""
    key = ["site", "url"]
    parts = [
        fit.select(*key, (F.col("indexability") == "NOINDEX").alias("noindex")), barriers.select(*key, "blocked"), entities.structured_visible(ents).select(*key, "alignment"),
        answers.topic_answers(topics, units).groupBy(*key).agg(F.count_if(F.col("status") == "UNSUPPORTED_HEADING").alias("unsupported_topics")), grounded.groupBy(*key).agg(F.count_if(F.col("support") == "CONTRADICTED_ON_SITE").alias("contradicted_claims")),
        answers.hidden_answers(assets, units),
        answers.structured_fields(good, ents).groupBy(*key).agg(F.array_sort(F.collect_set(F.when(F.col("status") == "DISAGREEMENT", F.col("field")))).alias("disagreements")),
        link.groupBy("site", F.col("source_url").alias("url")).agg(F.count_if("is_empty_anchor").alias("empty_anchors")), links.link_evidence(link).select("site", F.col("source_url").alias("url"), "generic_anchors"),
        findings.groupBy(*key).agg(F.when(F.max(F.col("severity") == "CRITICAL"), "CRITICAL").when(F.max(F.col("severity") == "HIGH"), "HIGH").otherwise("LOW").alias("security"), F.max(F.col("code") == "SEC_CSP_MISSING").alias("csp_missing"), F.max(F.col("code") == "SEC_HSTS_MISSING").alias("hsts_missing"), F.max(F.col("code").isin("SEC_ACTIVE_MIXED_CONTENT", "SEC_PASSIVE_MIXED_CONTENT")).alias("mixed_content")),
        access.groupBy(*key).agg(F.count_if(F.col("severity") == "CRITICAL").alias("accessibility_critical")), body.select(*key, "tier", "placeholders"), trust.select(*key, F.col("technical").alias("technical_trust")), cite.select(*key, "answer_first_ratio", "citability"),
    ]
    out = good.select(*key)
    for part in parts:
        out = out.join(part, key, "left")
    return out


def compare_sites(tables: dict[str, DataFrame], a: str, b: str) -> DataFrame:
    """Measure by measure, two sites of an audit, with the winner."""
    s = tables["health"].groupBy("site").agg(*[F.round(F.avg(c), 1).alias(c) for c in ("technical_score", "citability", "trust", "health")])
    return scores.compare(s, a, b)


def site_gaps(tables: dict[str, DataFrame], a: str, b: str, sites: DataFrame | None = None) -> DataFrame:
    """What the weaker of two sites of an audit should do to catch up; sites (site, llms_txt, ttfb_ms, referring_domains)
    adds what the audit doesn't measure."""
    means = tables["health"].groupBy("site").agg(F.avg("health").alias("health"))
    for name, columns in (("citability", {"answer_first": F.avg("answer_first_ratio")}), ("trust", {"technical_trust": F.avg("technical")})):
        means = means.join(tables[name].groupBy("site").agg(*[v.alias(k) for k, v in columns.items()]), "site", "left")
    gaps = tables["security"].groupBy("site").agg(F.count_if(F.col("code").isin("SEC_HSTS_MISSING", "SEC_CSP_MISSING", "SEC_X_FRAME_OPTIONS_MISSING")).alias("security_gaps"))
    declared = tables["package"].select("site", F.exists("schema_types", lambda t: t.rlike("Organization|LocalBusiness")).alias("organization_schema"))
    out = means.join(gaps, "site", "left").join(declared, "site", "left")
    return scores.gap_actions(out if sites is None else out.join(sites, "site", "left"), a, b)


def benchmark(tables: dict[str, DataFrame], target: str | None = None) -> dict[str, DataFrame]:
    """The sites of an audit against one another, and a target against the rest."""
    review, package = tables["review"], tables["package"]
    items = {k: package.select("site", F.explode(k).alias("item")) for k in ("entities", "services", "topics", "schema_types")}
    out = {f"{k}_frequency": cohort.frequency(v) for k, v in items.items()}
    out |= {"overlap": cohort.overlap_matrix(items["topics"]), "facets": cohort.facets(review), "voids": cohort.voids(review), "uncertainty": cohort.uncertainty(package), "statements": cohort.facts_and_analyses(review), "matrix": cohort.cross_site_matrix(package)}
    if target:
        out["target"] = cohort.target_vs_cohort(package, target)
    return out


def run_checked(steps: dict[str, Callable[[], DataFrame]]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Build each table; those that can't be built are named with their error, none is lost in silence."""
    done, failed = {}, {}
    for name, step in steps.items():
        try:
            done[name] = step()
        except Exception as e:  # the error is the result
            failed[name] = f"{type(e).__name__}: {e}"
    return done, failed
