"""Entities of pages and sites: from structured data, meta tags, visible signals and brand names."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, urls

# Schema.org types by kind of entity.
TYPES = {
    "ORGANIZATION": "Organization Corporation EducationalOrganization GovernmentOrganization NGO NewsMediaOrganization OnlineBusiness PerformingGroup SportsOrganization Airline",
    "LOCAL_BUSINESS": "LocalBusiness Store Restaurant MedicalBusiness FinancialService ProfessionalService LegalService AutomotiveBusiness AutoRepair Hotel LodgingBusiness HealthAndBeautyBusiness FoodEstablishment",
    "PERSON": "Person Author", "PRODUCT": "Product IndividualProduct ProductGroup ProductModel SoftwareApplication", "SERVICE": "Service FinancialProduct GovernmentService",
    "PLACE": "Place CivicStructure TouristAttraction AdministrativeArea City Country State LandmarksOrHistoricalBuildings",
}
KIND = {t: k for k, names in TYPES.items() for t in names.split()}
# Endings of company names.
SUFFIXES = r"(?i)[\s,]+(inc|incorporated|llc|llp|ltd|limited|pvt|private|corp|corporation|co|company|gmbh|ag|sa|sarl|bv|plc|pty|oy)\.?(?=$|[\s,])"
ENTITY = "array<struct<type:string, schema_type:string, name:string, source:string, signal:string, id:string, same_as:array<string>, phone:string, address:string, rel:string, rel_target:string>>"


def entity_name(name: Column) -> Column:
    """A name without quotes, company endings, punctuation and case; the plain lower-cased name if nothing is left."""
    clean = F.trim(F.regexp_replace(name, "[\"'`]", ""))
    t = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(clean, SUFFIXES, "")), text.NOT_WORD, " "), r"\s+", " "))
    return F.when(t != "", t).otherwise(F.lower(clean))


def phone_number(phone: Column) -> Column:
    return F.regexp_replace(phone, r"[^\d+]", "")


def _address(a) -> str | None:
    if isinstance(a, str):
        return a.strip()
    if isinstance(a, dict):
        return ", ".join(str(a[k]).strip() for k in ("streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry") if isinstance(a.get(k), str) and a[k].strip()) or None
    return None


RELATED = {"brand": "product_to_organization", "manufacturer": "product_to_organization", "provider": "service_to_organization", "worksFor": "person_to_organization", "affiliation": "person_to_organization", "publisher": "organization_to_website"}


def jsonld_entities(blocks) -> list[dict]:
    """Entities of JSON-LD blocks: lists and @graph are opened, nested items followed, broken blocks left out."""
    out: list[dict] = []
    todo = []
    for b in blocks if blocks is not None else []:
        try:
            todo.append((json.loads(b), None, None))
        except ValueError:
            continue
    while todo:
        x, rel, parent = todo.pop(0)
        if isinstance(x, list):
            todo[:0] = [(i, rel, parent) for i in x]
            continue
        if not isinstance(x, dict):
            continue
        if "@graph" in x:
            todo.insert(0, (x["@graph"], None, None))
        types = x.get("@type")
        types = types if isinstance(types, list) else [types]
        name = x.get("name") or x.get("legalName")
        if isinstance(name, str) and name.strip() and any(isinstance(t, str) for t in types):
            schema = next(t for t in types if isinstance(t, str))
            same = x.get("sameAs") or []
            same = [s for s in (same if isinstance(same, list) else [same]) if isinstance(s, str)]
            phone = x.get("telephone")
            out.append({"type": next((KIND[t] for t in types if t in KIND), "OTHER"), "schema_type": schema, "name": name.strip(), "source": "JSON_LD", "signal": "structured_data_declaration", "id": x.get("@id") if isinstance(x.get("@id"), str) else None, "same_as": same, "phone": phone if isinstance(phone, str) else None, "address": _address(x.get("address")), "rel": rel, "rel_target": parent})
            parent_name = name.strip()
        else:
            parent_name = parent
        for k, v in x.items():
            if k not in ("@graph", "address") and isinstance(v, (dict, list)):
                todo.append((v, RELATED.get(k), parent_name if k in RELATED else None))
    return out


def page_entities(parsed: DataFrame) -> DataFrame:
    """site, url, type, name, normalized, source, signal, phone, address, same_as, ...: each entity of a page once, from
    JSON-LD before microdata, meta tags and visible signals; a brand name where no organization is declared."""

    def run(blocks: pd.Series) -> pd.Series:
        return blocks.map(jsonld_entities)

    p = parsed.where("p is not null")
    none = lambda kind="string": F.lit(None).cast(kind)
    item = lambda kind, schema, name, source, signal, phone=None, address=None: F.struct(F.lit(kind).alias("type"), schema.alias("schema_type"), name.alias("name"), F.lit(source).alias("source"), F.lit(signal).alias("signal"), none().alias("id"), F.array().cast("array<string>").alias("same_as"), (phone if phone is not None else none()).alias("phone"), (address if address is not None else none()).alias("address"), none().alias("rel"), none().alias("rel_target"))
    kinds = F.create_map(*[F.lit(x) for k, v in KIND.items() for x in (k, v)])
    micro = F.transform(F.filter("p.microdata", lambda m: m["name"] != ""), lambda m: F.struct(F.coalesce(F.try_element_at(kinds, m["type"]), F.lit("OTHER")).alias("type"), m["type"].alias("schema_type"), m["name"].alias("name"), F.lit("MICRODATA").alias("source"), F.lit("structured_data_declaration").alias("signal"), none().alias("id"), F.array().cast("array<string>").alias("same_as"), none().alias("phone"), none().alias("address"), none().alias("rel"), none().alias("rel_target")))
    meta = F.col("p.meta")
    named = F.filter(F.array(meta.getItem("og:site_name"), meta.getItem("application-name")), lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")
    metas = F.transform(F.array_distinct(named), lambda n: item("ORGANIZATION", none(), n, "META_TAG", "brand_or_site_name_signal"))
    rights = F.transform("p.copyright", lambda n: item("ORGANIZATION", none(), n, "VISIBLE_HTML", "copyright_signal"))
    author = F.when(F.trim(F.coalesce("p.author", F.lit(""))) != "", F.array(item("PERSON", none(), F.col("p.author"), "META_TAG", "author_byline_signal"))).otherwise(F.array().cast(ENTITY))
    contact = F.transform(F.array_union("p.phones", "p.emails"), lambda c: item("OTHER", none(), c, "VISIBLE_HTML", "contact_signal", phone=F.when(~F.contains(c, F.lit("@")), c)))
    places = F.transform("p.address", lambda a: item("PLACE", none(), a, "VISIBLE_HTML", "contact_signal", address=a))
    parts = [F.pandas_udf(run, ENTITY)("p.jsonld"), micro, metas, rights, author, contact, places]
    e = p.select("site", "url", F.posexplode(F.concat(*[x.cast(ENTITY) for x in parts])).alias("pos", "e")).select("site", "url", "pos", "e.*")
    e = e.withColumn("normalized", entity_name(F.col("name")))
    order = F.when(F.col("source") == "JSON_LD", 0).when(F.col("source") == "MICRODATA", 1).when(F.col("source") == "META_TAG", 2).otherwise(3)
    first = e.groupBy("site", "url", "type", "normalized").agg(F.min_by(F.struct("name", "schema_type", "source", "signal", "id", "rel", "rel_target"), F.struct(order, "pos")).alias("f"), F.max("phone").alias("phone"), F.max("address").alias("address"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("same_as")))).alias("same_as"), F.sort_array(F.collect_set("source")).alias("sources"))
    found = first.select("site", "url", "type", "normalized", "f.*", "phone", "address", "same_as", "sources")
    have = found.where("type in ('ORGANIZATION', 'LOCAL_BUSINESS')").select("site", "url").distinct()
    brand = brand_candidates(p.join(have, ["site", "url"], "left_anti")).select("site", "url", F.lit("ORGANIZATION").alias("type"), "normalized", "name", none().alias("schema_type"), F.lit("VISIBLE_HTML").alias("source"), F.lit("brand_or_site_name_signal").alias("signal"), none().alias("id"), none().alias("rel"), none().alias("rel_target"), none().alias("phone"), none().alias("address"), F.array().cast("array<string>").alias("same_as"), F.array(F.lit("VISIBLE_HTML")).alias("sources"))
    return found.unionByName(brand)


REJECTED = r"(?i)^(home|homepage|welcome|about( us)?|contact( us)?|services?|products?|blog|news|untitled|index|page|login|404.*|error.*)$"


def brand_candidates(parsed: DataFrame, least: int = 35) -> DataFrame:
    """site, url, name, normalized, score: parts of title and H1 that may be the site's name, the best of each page.

    50 for the domain itself, 40 for a name that holds it, 30 for one in it (four letters or more), 25 for words that
    cover 40 % of it; 20 more for a part of the title, and for an H1. It takes the domain itself or two signals.
    """
    domain = F.regexp_replace(F.element_at(F.split(urls.root_domain(urls.host(F.col("url"))), r"\."), 1), "[^a-z0-9]", "")
    parts = F.filter(F.transform(F.split("p.title", r"\s*[-|–—:]\s+|\s+::\s+|\s+/\s+"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(REJECTED))
    heads = F.filter(F.transform("p.h1", lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(REJECTED))
    c = parsed.where("p is not null").select("site", "url", domain.alias("d"), parts.alias("ts"), heads.alias("hs")).where(F.length("d") >= 3).select("*", F.posexplode(F.array_union("ts", "hs")).alias("pos", "name"))
    c = c.withColumn("normalized", entity_name(F.col("name"))).withColumn("k", F.regexp_replace("normalized", "[^a-z0-9]", "")).where("k <> ''")
    cover = F.aggregate(F.filter(F.array_distinct(F.split("normalized", " ")), lambda t: (F.length(t) >= 4) & F.contains(F.col("d"), t)), F.lit(0), lambda a, t: a + F.length(t))
    score = F.when(F.col("k") == F.col("d"), 50).when(F.contains("k", F.col("d")), 40).when(F.contains("d", F.col("k")) & (F.length("k") >= 4), 30).when(cover >= F.greatest(F.lit(4), 0.4 * F.length("d")), 25).otherwise(0)
    squeeze = lambda a: F.transform(a, lambda x: F.regexp_replace(entity_name(x), "[^a-z0-9]", ""))
    t, h = F.array_contains(squeeze(F.col("ts")), F.col("k")), F.array_contains(squeeze(F.col("hs")), F.col("k"))
    c = c.withColumn("ds", score).withColumn("t", t).withColumn("h", h)
    n = (F.col("ds") > 0).cast("int") + F.col("t").cast("int") + F.col("h").cast("int")
    total = F.col("ds") + F.when(F.col("t"), 20).otherwise(0) + F.when(F.col("h"), 20).otherwise(0)
    c = c.where((F.col("ds") == 50) | (n >= 2)).withColumn("score", total).where(F.col("score") >= least)
    w = Window.partitionBy("site", "url").orderBy(F.desc("score"), "pos")
    return c.withColumn("r", F.row_number().over(w)).where("r = 1").select("site", "url", "name", "normalized", "score")


def entity_relations(entities: DataFrame) -> DataFrame:
    """site, url, source, target, relation: declared relations, and organizations with their site, profiles and places."""
    org = entities.where("type in ('ORGANIZATION', 'LOCAL_BUSINESS') and source = 'JSON_LD'")
    a = entities.where("rel is not null and rel_target is not null").select("site", "url", F.col("rel_target").alias("source"), F.col("name").alias("target"), F.col("rel").alias("relation"))
    b = org.select("site", "url", F.col("name").alias("source"), F.col("site").alias("target"), F.lit("organization_to_website").alias("relation"))
    c = org.select("site", "url", F.col("name").alias("source"), F.explode("same_as").alias("target"), F.lit("organization_to_social_profile").alias("relation"))
    d = org.where("address is not null").select("site", "url", F.col("name").alias("source"), F.col("address").alias("target"), F.lit("organization_to_location").alias("relation"))
    return a.union(b).union(c).union(d).distinct()


def name_alignment(a: Column, b: Column) -> Column:
    """How two names agree: EXACT_MATCH, NORMALIZED_MATCH, PARTIAL_MATCH (one in the other, or half the words), or not."""
    na, nb = entity_name(a), entity_name(b)
    wa, wb = F.array_distinct(F.split(na, " ")), F.array_distinct(F.split(nb, " "))
    both = F.size(F.array_intersect(wa, wb))
    part = (F.size(F.array_except(wa, wb)) == 0) | (F.size(F.array_except(wb, wa)) == 0) | (both / F.greatest(F.size(F.array_union(wa, wb)), F.lit(1)) >= 0.5)
    return F.when(a.isNull() | b.isNull(), "UNAVAILABLE").when(a == b, "EXACT_MATCH").when(na == nb, "NORMALIZED_MATCH").when(part, "PARTIAL_MATCH").otherwise("DIVERGENT_IDENTITY_SUSPECTED")


def structured_visible(entities: DataFrame) -> DataFrame:
    """site, url, structured, visible, alignment: the declared organization against the visible one of a page."""
    org = entities.where("type in ('ORGANIZATION', 'LOCAL_BUSINESS')")
    return org.groupBy("site", "url").agg(F.min(F.when(F.col("source").isin("JSON_LD", "MICRODATA"), F.col("name"))).alias("structured"), F.min(F.when(F.col("source").isin("META_TAG", "VISIBLE_HTML"), F.col("name"))).alias("visible")).withColumn("alignment", name_alignment(F.col("structured"), F.col("visible")))


def entity_profiles(entities: DataFrame) -> DataFrame:
    """Per site and organization: its names, addresses and phones with their pages, and which of them differ."""
    org = entities.where("type in ('ORGANIZATION', 'LOCAL_BUSINESS')")
    out = org.groupBy("site", "normalized").agg(
        F.count_distinct("url").alias("pages"), F.sort_array(F.collect_set("name")).alias("names"), F.sort_array(F.collect_set("address")).alias("addresses"), F.sort_array(F.collect_set(phone_number(F.col("phone")))).alias("phones"),
        F.sort_array(F.collect_set("url")).alias("urls"), F.count_if(F.col("source") == "JSON_LD").alias("jsonld"),
    )
    return out.withColumn("inconsistent", F.filter(F.array(F.when(F.size("names") > 1, "name"), F.when(F.size("addresses") > 1, "address"), F.when(F.size("phones") > 1, "phone")), lambda x: x.isNotNull()))


def primary_organization(entities: DataFrame) -> DataFrame:
    """site, normalized, name, score of the organization with most of 2 a page, 10 for the root page, 5 for JSON-LD."""
    org = entities.where("type in ('ORGANIZATION', 'LOCAL_BUSINESS')").withColumn("root", urls.path(F.col("url")).isin("", "/"))
    s = org.groupBy("site", "normalized").agg(F.min("name").alias("name"), (2 * F.count("*") + 10 * F.max(F.col("root").cast("int")) + 5 * F.max((F.col("source") == "JSON_LD").cast("int"))).alias("score"), F.min("url").alias("first"))
    w = Window.partitionBy("site").orderBy(F.desc("score"), "first", "normalized")
    return s.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k", "first")
