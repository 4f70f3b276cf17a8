"""One parse of each page into typed columns; everything else is expressions over them.

parse_pages adds a struct column `p` to a crawl table, so that the HTML is read once and can be dropped right after.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .dom import Node, parse

# Elements that never hold main content.
BOILERPLATE = frozenset("script style nav footer header aside noscript svg canvas form dialog iframe".split())
# Names in class or id of what is not main content, and roles.
NOISE = re.compile(r"\b(sidebar|menu|footer|header|cookie|popup|modal|banner|nav|navigation|toolbar|widget-area)\b", re.I)
ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary"))
HEADING = ("h1", "h2", "h3", "h4", "h5", "h6")

SCHEMA = """struct<
title: string, h1: array<string>, headings: array<struct<pos:int, level:int, text:string, words:int>>,
meta: map<string,string>, canonical: array<string>, lang: string, charset: boolean, viewport: string,
links: array<struct<pos:int, href:string, text:string, alt:string, aria:string, rel:array<string>, target:string, nav:boolean, section:string>>,
images: array<struct<pos:int, src:string, alt:string, width:string, height:string, loading:string, srcset:string, role:string, hidden:boolean, in_link:string, caption:string, inside:boolean, heading:string>>,
jsonld: array<string>, microdata: array<struct<type:string, name:string>>,
main_text: string, main_method: string, body_words: int, visible_text: string, crawl_words: int, paragraphs: int,
blocks: array<string>, texts: array<string>, resources: array<struct<tag:string, url:string>>, ids: array<string>,
forms: array<struct<pos:int, purpose:string, method:string, action:string, controls:int, labelled:int, search:boolean, submit:string>>,
unlabelled: int, empty_links: int, empty_buttons: int, images_without_alt: int, bad_roles: array<string>, buttons: int, mains: int,
units: array<struct<pos:int, kind:string, heading:string, text:string, level:int, whole:string, obscured:boolean>>,
scripts: int, spa_root: boolean, videos: int, audios: int, captions: int, copyright: array<string>, phones: array<string>, emails: array<string>, address: array<string>, code_blocks: int, blockquotes: int, author: string, nosnippet: int, name_clashes: int
>"""
# The roles of the ARIA standard.
ARIA_ROLES = frozenset(
    """alert alertdialog application article banner blockquote button caption cell checkbox code columnheader combobox complementary contentinfo definition deletion dialog directory document emphasis feed figure form generic grid gridcell group heading img image
    insertion link list listbox listitem log main marquee math menu menubar menuitem menuitemcheckbox menuitemradio meter navigation none note option paragraph presentation progressbar radio radiogroup region row rowgroup rowheader scrollbar search searchbox
    separator slider spinbutton status strong subscript superscript suggestion switch tab table tablist tabpanel term textbox time timer toolbar tooltip tree treegrid treeitem""".split()
)
# Names of buttons that exclude each other.
CLASHES = (("submit", "cancel"), ("save", "delete"), ("next", "previous"), ("open", "close"), ("login", "logout"))
COPYRIGHT = re.compile(r"(?:©|\(c\)|copyright)\s*(?:©\s*)?(?:\d{4}(?:\s*[-–]\s*\d{4})?)?\s*,?\s*(?:by\s+)?([A-Z][\w&.,' -]{1,60})", re.I)
DEFINITION = re.compile(r"^\S+(?:\s+\S+){0,7}\s+(?:is|are|refers to|means|is defined as)\s+(?:an?|the|any|how|when)\b", re.I)
QUESTION = re.compile(r"^(?:what|why|how|when|where|who|which|can|does|do|is|are|should)\b|\?$", re.I)
REQUIRE = re.compile(r"\b(?:must|required|requirements?|eligib\w+|prerequisites?|mandatory)\b", re.I)
MAIL, PHONE, DIGIT = re.compile(r"[\w.+-]+@[\w-]+\.[\w.]+"), re.compile(r"\d[\d ()-]{7,}\d"), re.compile(r"\d")
POLICY = re.compile(r"\b(?:updated|effective|revised|valid until|published)\b.{0,30}\b\d{4}\b", re.I)
STANDARD = re.compile(r"\b(?:ISO|IEC|ASTM|EN|DIN|IEEE|ANSI|BS|NABL|NIST)[ /-]*[A-Z]*[ -]?\d{2,6}(?:[-:]\d+)*\b|\b\d+(?:\.\d+)?\s?(?:%|percent)")
STEPS = re.compile(r"\b(?:step|phase|stage|how to)\b", re.I)


#: In lower case, what REQUIRE takes holds one of these, or a letter that only folds to one of theirs.
REQUIRED = ("must", "requir", "eligib", "prerequisite", "mandatory", "\u017f", "\u0131", "\u0307")


def _kind(t: str) -> str | None:
    """The kind of a paragraph by words of its own; what no pattern could find isn't searched for."""
    low, digit = t.lower(), DIGIT.search(t)
    if any(w in low for w in REQUIRED) and REQUIRE.search(t) and len(t.split()) >= 8:
        return "REQUIREMENTS_ELIGIBILITY"
    if ("@" in t and MAIL.search(t)) or (digit and PHONE.search(t)):
        return "LOCATION_CONTACT"
    if digit and POLICY.search(t):
        return "DATE_POLICY"
    return "FACTUAL_STATEMENT" if digit and STANDARD.search(t) else None


def _clean(node: Node) -> str:
    return " ".join(node.text(BOILERPLATE).split())


def _noise(x: Node) -> bool:
    if x.get("aria-hidden") == "true" or (x.get("role") or "").lower() in ROLES:
        return True
    return bool(NOISE.search(x.get("class") or "") or NOISE.search(x.get("id") or ""))


def main_content(root: Node) -> tuple[str, str, int]:
    """Text, how it was found, and the words of the body."""
    body = root.find("body") or root
    raw = body.text(frozenset(("script", "style", "noscript")))
    words = len(raw.split())
    main = root.find("main")
    for node, method in ((main, "SEMANTIC_MAIN"), (next((x for x in root.walk() if x.get("role") == "main"), None), "ROLE_MAIN")):
        if node is not None and len((t := _clean(node)).split()) >= 15:
            return t, method, words
    t = " ".join(x for x in map(_clean, root.find_all("article")) if x)
    if len(t.split()) >= 15:
        return t, "SEMANTIC_ARTICLE", words
    t = " ".join(body.text(BOILERPLATE, _noise).split())
    return (t, "HEURISTIC_PRUNED_BODY", words) if t else (" ".join(raw.split()), "RAW_BODY_FALLBACK", words)


def _section_words(h: Node) -> int:
    n, after = 0, False
    for x in h.parent.children:
        if x is h:
            after = True
        elif after and isinstance(x, Node):
            if x.name in HEADING:
                break
            if x.name not in BOILERPLATE:
                n += len(x.text().split())
    return n


def _hidden(x: Node) -> bool:
    return x.has("hidden") or x.get("aria-hidden") == "true" or "display:none" in (x.get("style") or "").replace(" ", "")


def _name(x: Node) -> str:
    return x.text() or (x.get("aria-label") or x.get("title") or "").strip() or " ".join(a for i in x.find_all("img") if (a := (i.get("alt") or "").strip())) or ("labelled" if x.get("aria-labelledby") else "")


def _clashes(x: Node) -> bool:
    """A button that shows one thing and tells assistive software its opposite."""
    if x.name == "input" and (x.get("type") or "").lower() not in ("submit", "button", "reset"):
        return False
    shown, told = (x.text() or x.get("value") or "").lower(), x.get("aria-label").lower()
    return any((a in shown and b in told) or (b in shown and a in told) for a, b in CLASHES)


def _control_labelled(x: Node, labels: set[str]) -> bool:
    return bool(x.get("aria-label") or x.get("aria-labelledby") or x.get("title") or x.get("id") in labels or x.within("label"))


def _units(root: Node) -> list[dict]:
    """Answer units: lists, tables, definitions and paragraphs after headings, by position."""
    out, heading, level = [], "", 0

    def put(kind, text):
        out.append({"pos": len(out), "kind": kind, "heading": heading, "text": text[:350], "level": level, "whole": text, "obscured": any(a.has("data-nosnippet") for a in (x, *x.ancestors()))})

    for x in root.walk():
        if x.name in HEADING:
            heading, level = x.text(), int(x.name[1])
            continue
        if x.within("nav", "footer", "header", "aside"):
            continue
        if x.name == "table" and len(x.find_all("tr")) >= 2:
            put("TABLE", x.text())
        elif x.name == "dl" and x.find("dt"):
            put("DEFINITION", x.text())
        elif x.name == "details":
            put("FAQ", x.text())
        elif x.name == "ol" and len(x.find_all("li")) >= 2:
            put("PROCEDURE_STEPS", x.text())
        elif x.name == "ul" and len(items := x.find_all("li")) >= 3 and sum(len(i.text().split()) for i in items) / len(items) >= 3:
            put("LIST", x.text())
        elif x.name in ("pre", "blockquote"):
            put("EXAMPLE", x.text())
        elif x.name == "p":
            t = " ".join(x.text().split())
            n = len(t.split())
            if n < 3:
                continue
            if QUESTION.search(heading) and n >= 4:
                put("DIRECT_ANSWER", t)
            elif DEFINITION.search(t) or x.find("dfn"):
                put("DEFINITION", t)
            elif kind := _kind(t):
                put(kind, t)
            elif heading and n >= 10:
                put("PROCEDURE_STEPS" if STEPS.search(heading) else "SERVICE_DESCRIPTION" if re.search(r"\bservices?\b", heading, re.I) else "FACTUAL_STATEMENT", t)
    return out


class _Walked:
    """A node whose elements are listed once, by name."""

    def __init__(self, node: Node):
        self.node, self.all, self.named = node, list(node.walk()), {}
        for i, x in enumerate(self.all):
            self.named.setdefault(x.name, []).append((i, x))

    def walk(self) -> list[Node]:
        return self.all

    def find_all(self, *names: str) -> list[Node]:
        found = [x for n in names for x in self.named.get(n, ())]
        return [x for _, x in (sorted(found, key=lambda x: x[0]) if len(names) > 1 else found)]

    def find(self, *names: str) -> Node | None:
        return next(iter(self.find_all(*names)), None)

    def text(self, skip=frozenset(), drop=None, sep: str = " ") -> str:
        return self.node.text(skip, drop, sep)


def page_record(page: str, fields: list[str] | None = None) -> dict:
    """The fields of SCHEMA, or some of them: what they don't need isn't worked out."""
    fields = FIELDS if fields is None else fields
    want = lambda *f: any(x in fields for x in f)
    root = _Walked(parse(page))
    title = root.find("title")
    text, method, words = main_content(root) if want("main_text", "main_method", "body_words") else (None, None, None)
    body = root.find("body")
    body = _Walked(body) if body is not None else root
    html_tag = root.find("html")
    meta: dict[str, str] = {}
    charset = False
    for m in root.find_all("meta"):
        charset |= m.has("charset") or (m.get("http-equiv") or "").lower() == "content-type"
        key = (m.get("name") or m.get("property") or m.get("itemprop") or "").strip().lower()
        if key and m.get("content") is not None:
            meta[key] = f"{meta[key]},{m.get('content').strip()}" if key in meta and key in ROBOT_META else meta.get(key, m.get("content").strip())
    labels = {x.get("for") for x in root.find_all("label") if x.get("for")}
    links, last = [], ""
    headings, images = [], []
    for x in root.walk() if want("headings", "links", "images") else ():
        if x.name in HEADING:
            last = x.text(sep="")
            if want("headings"):
                headings.append({"pos": len(headings), "level": int(x.name[1]), "text": last, "words": _section_words(x)})
        elif x.name == "a" and (x.get("href") or "").strip() and want("links"):
            alts = [a for i in x.find_all("img") if (a := (i.get("alt") or "").strip())]
            aria = (x.get("aria-label") or x.get("title") or "").strip()
            links.append({"pos": len(links), "href": x.get("href").strip(), "text": x.text(), "alt": " ".join(alts), "aria": aria, "rel": (x.get("rel") or "").lower().split(), "target": x.get("target"), "nav": x.within("nav", "header", "footer"), "section": last})
        elif x.name == "img" and want("images"):
            link = next((a for a in x.ancestors() if a.name == "a"), None)
            figure = next((a for a in x.ancestors() if a.name == "figure"), None)
            caption = figure.find("figcaption") if figure is not None else None
            images.append(
                {
                    "pos": len(images), "src": x.get("src") or x.get("data-src") or "", "alt": x.attrs.get("alt"), "width": x.get("width"), "height": x.get("height"), "loading": (x.get("loading") or "").lower(),
                    "srcset": x.get("srcset"), "role": (x.get("role") or "").lower(), "hidden": _hidden(x), "in_link": link.text() if link is not None else None,
                    "caption": caption.text() if caption is not None else None, "inside": x.within("main", "article", "section", "figure"), "heading": last,
                }
            )
    forms = []
    for f in root.find_all("form") if want("forms") else ():
        controls = [c for c in f.find_all("input", "select", "textarea") if (c.get("type") or "").lower() not in ("hidden", "submit", "button", "reset", "image")]
        kinds = {(c.get("type") or "").lower() for c in controls}
        words_ = " ".join([f.get("id") or "", f.get("class") or "", f.get("action") or "", f.get("role") or ""]).lower()
        search = f.get("role") == "search" or "search" in kinds or "search" in words_
        purpose = "LOGIN_ACCOUNT_SURFACE" if "password" in kinds else "SEARCH_FORM" if search else "CONTACT_INQUIRY_FORM" if f.find("textarea") or "email" in kinds or "contact" in words_ else "FORM_CONTROL"
        submit = next((_name(b) or b.get("value") or "" for b in f.find_all("button", "input") if b.name == "button" or (b.get("type") or "").lower() == "submit"), None)
        forms.append({"pos": len(forms), "purpose": purpose, "method": (f.get("method") or "get").lower(), "action": f.get("action"), "controls": len(controls), "labelled": sum(_control_labelled(c, labels) for c in controls), "search": search, "submit": submit})
    inputs = [c for c in root.find_all("input", "select", "textarea") if (c.get("type") or "").lower() not in ("hidden", "submit", "button", "reset", "image")]
    leaves = []
    for x in body.find_all("p", "li", "div", "section") if want("blocks") else ():
        if x.find("p", "div", "section") is None:
            t = re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", x.text().lower())).strip()
            if len(t.split()) >= 6:
                leaves.append(t)
    resources = [{"tag": "style" if x.name == "link" else x.name, "url": u} for x in root.find_all("script", "link", "iframe", "img", "audio", "video", "source", "object") if (u := (x.get("href") if x.name == "link" else x.get("src") or x.get("data")) or "") and (x.name != "link" or "stylesheet" in (x.get("rel") or "").lower())]
    flat = " ".join(root.text(frozenset(("script", "style", "noscript", "template", "title"))).split()) if want("visible_text", "copyright") else ""
    made = {
        "title": lambda: title.text(sep="").strip() if title is not None else "",
        "h1": lambda: [t for h in root.find_all("h1") if (t := h.text())],
        "headings": lambda: headings, "meta": lambda: meta,
        "canonical": lambda: [(x.get("href") or "").strip() for x in root.find_all("link") if "canonical" in (x.get("rel") or "").lower().split()],
        "lang": lambda: html_tag.get("lang") if html_tag is not None else None, "charset": lambda: charset, "viewport": lambda: meta.get("viewport"),
        "links": lambda: links, "images": lambda: images,
        "jsonld": lambda: [t for s in root.find_all("script") if (s.get("type") or "").lower() == "application/ld+json" and (t := "".join(s.strings()).strip())],
        "microdata": lambda: [{"type": (x.get("itemtype") or "").rstrip("/").rsplit("/", 1)[-1], "name": next((n.text() or n.get("content") or "" for n in x.walk() if n.get("itemprop") == "name"), "")} for x in root.walk() if x.get("itemtype")],
        "main_text": lambda: text, "main_method": lambda: method, "body_words": lambda: words, "visible_text": lambda: flat,
        "crawl_words": lambda: len(root.text(frozenset(("script", "style", "nav", "footer"))).split()),
        "paragraphs": lambda: sum(1 for x in body.find_all("p") if len(x.text().split()) > 3),
        "blocks": lambda: leaves, "texts": lambda: [t for x in body.find_all("p", "li", "td", "dd") if len(t := " ".join(x.text().split())) >= 15], "resources": lambda: resources, "ids": lambda: [x.get("id") for x in root.walk() if x.get("id")],
        "forms": lambda: forms, "unlabelled": lambda: sum(not _control_labelled(c, labels) for c in inputs),
        "empty_links": lambda: sum(1 for a in root.find_all("a") if a.get("href") and not _hidden(a) and not _name(a)),
        "empty_buttons": lambda: sum(1 for b in root.find_all("button") if not _hidden(b) and not _name(b)),
        "images_without_alt": lambda: sum(1 for i in root.find_all("img") if not i.has("alt") and not _hidden(i) and (i.get("role") or "") not in ("presentation", "none")),
        "bad_roles": lambda: [r for x in root.walk() if (r := (x.get("role") or "").strip().lower()) and r.split()[0] not in ARIA_ROLES],
        "buttons": lambda: len(root.find_all("button")), "mains": lambda: sum(1 for x in root.walk() if x.name == "main" or x.get("role") == "main"),
        "units": lambda: _units(body), "scripts": lambda: len(root.find_all("script")),
        "spa_root": lambda: any(x.get("id") in ("root", "app", "__next", "__nuxt") for x in root.walk()),
        "videos": lambda: len(root.find_all("video")), "audios": lambda: len(root.find_all("audio")), "captions": lambda: len(root.find_all("track")),
        "copyright": lambda: list(dict.fromkeys(m.strip(" .,-") for m in COPYRIGHT.findall(flat)))[:5],
        "phones": lambda: list(dict.fromkeys(a.get("href")[4:].strip() for a in root.find_all("a") if (a.get("href") or "").lower().startswith("tel:")))[:3],
        "emails": lambda: list(dict.fromkeys(a.get("href")[7:].split("?")[0].strip().lower() for a in root.find_all("a") if (a.get("href") or "").lower().startswith("mailto:")))[:2],
        "address": lambda: [" ".join(x.text().split()) for x in root.find_all("address")],
        "code_blocks": lambda: len(root.find_all("code", "pre")), "blockquotes": lambda: len(root.find_all("blockquote", "q")),
        "author": lambda: meta.get("author") or next((x.text() for x in root.walk() if "author" in (x.get("rel") or "").split() or x.get("itemprop") == "author"), None),
        "nosnippet": lambda: sum(1 for x in root.walk() if x.has("data-nosnippet")), "name_clashes": lambda: sum(_clashes(x) for x in root.find_all("button", "input") if x.get("aria-label")),
    }
    return {f: made[f]() for f in fields}


ROBOT_META = frozenset(("robots", "googlebot", "bingbot"))


def parse_pages(crawl: DataFrame, column: str = "raw_html", fields: list[str] | None = None) -> DataFrame:
    """The crawl table with a struct `p` in place of its HTML, of all fields or some; a null or empty page has a null struct."""
    fields = FIELDS if fields is None else fields

    def run(pages: pa.Array) -> pa.Array:
        found = (page_record(h, fields) if h else None for h in pages.to_pylist())
        return pa.array([{**r, "meta": list(r["meta"].items())} if r and "meta" in r else r for r in found], kind)

    schema = StructType([f for f in StructType.fromDDL(SCHEMA.replace("\n", " ")[7:-2]) if f.name in fields])
    kind = to_arrow_type(schema)
    # named nondeterministic, so that a filter which is inferred from what follows (an explode of the links, say) isn't
    # pushed below, where it would parse every page once more
    parsed = F.arrow_udf(run, schema).asNondeterministic()(F.col(column))
    out = crawl.withColumn("p", parsed)
    return out.withColumn("p", F.when(F.length(column) > 0, F.struct(*[F.col(f"p.{f}").alias(f) for f in fields]))).drop(column)


FIELDS = re.findall(r"(\w+): ", re.sub(r"struct<[^<>]*(?:<[^<>]*>[^<>]*)*>", "x", SCHEMA.replace("struct<\n", "", 1)))
