"""Main text of web pages by two passes of rules over blocks.

A page is cut into blocks at block-level tags; scripts, styles, hidden parts and comments in the markup go, as does what
an element or a role says to be a menu, form, aside or footer. The first pass labels each block by its share of stop
words, its length and its share of linked text: long ones with enough stop words are good, those with few stop words
and runs of blocks that are mostly links are bad, and short ones are left open. Class and id names shift the thresholds:
a part named after adverts, comments and the like is bad where text stands outside such parts, and one whose name only
mentions them must be longer and denser to be good. Where a page marks its article, blocks in it need less to be good, and
blocks outside are bad. In the second pass an open block gets the label of its nearest decided neighbours; where they
differ, a heading goes with what follows, a block with stop words is good, and the rest go with the nearer one. Without
any, a block is good. On a page whose long blocks mostly lack stop words (another language), length and links decide.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

_RAW = r"script|style|noscript|template|svg|annotation-xml|annotation|iframe|object|textarea|select|canvas|audio|video|xmp|noembed|noframes|title"
PIECE = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<({_RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>|<[!?/a-zA-Z][^>]*>|[^<]+|<", re.S | re.I)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output picture progress q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr math semantics mrow mi mn mo mtext mspace ms mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mprescripts none mstyle mpadded mphantom menclose mtable mtr mtd".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
NOISE_TAGS = frozenset("nav footer aside form button menu dialog fieldset".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar alert dialog form toolbar".split())
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar side rail widget widgets related recommended recommendations trending popular share sharing social comment comments commentlist disqus reply replies respond discussion notice notices cookie cookies consent gdpr alert newsletter subscribe subscription signup popup modal overlay breadcrumb breadcrumbs menu nav navbar navigation masthead topbar toolbar pagination pager login search copyright legal disclaimer footer foot outbrain taboola paywall".split()
)
COMMENT_NAMES = frozenset("comment comments commentlist disqus reply replies respond".split())
#: Parts of a class that say that something is absent, or that an element is wrapped around it and the rest.
AROUND = frozenset("no not without with has wrap wrapper wrapped layout".split())
#: Parts of a class that leave the others their meaning: where a part stands, what it looks like, how often it comes.
GENERIC = frozenset(
    "site page main top bottom left right upper lower inner outer global primary secondary box block blocks list item items container section area bar row col column columns group link links button buttons icon icons panel module unit slot zone strip post posts article articles entry entries story stories title header heading text message msg form field inline sticky fixed mobile desktop google js id by thread count author date meta new the and".split()
)
ARTICLE_NAMES = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|page|main)[_-]?(?:body|content|text)(?:$|[\s_-])|^(?:articlebody|mainbody)$", re.I)
COMMENTS = re.compile(r"(?:\d+ )?(?:comments?|reader comments|leave a (?:comment|reply)|kommentare?|commentaires?|comentarios?)\b\W*(?:\(?\d+\)?)?$", re.I)
RELATED = re.compile(r"(?:related(?: posts| articles| stories)?|you may also like|read more|more from .{1,40}|share this(?: article| post)?|advertisement)\W*$", re.I)
NAME_PARTS = re.compile(r"[a-z]+")
# Frequent words of English, German, French, Spanish, Italian, Portuguese and Dutch.
STOP = frozenset(
    """the of and to in a is that it was for on are as with his they be at one have this from or had by but not what all were we when your can said there an which she do
    their if will each about how up out them then many some so these would other into has more two him see could no than first been its who now my made over did only
    der die das und ist von zu den mit des auf für im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei in
    le la les de des du et un une est que qui dans pour pas sur au plus par ce il elle ne se son avec sont aux ou mais nous comme leur cette ses ont
    el los las y en una por con para del se al lo como más pero sus o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos
    il di che non per una sono con gli della nel dei alla più anche ma
    o os um uma do da em não com para são mais como mas foi ao ele das tem seu sua
    het een van dat niet zijn op aan met voor er maar om hem dan zou wat""".split()
)
SHORT, LONG, LOW, HIGH, LINKS = 70, 200, 0.12, 0.22, 0.5
GOOD, BAD, OPEN, NEAR = range(4)
#: What an element's names say: nothing, that noise is mentioned, that it is noise, that it is readers' comments.
CLEAR, MENTIONS, NAMED, READERS = range(4)


class Block:
    __slots__ = ("text", "linked", "noise", "article", "heading", "named", "item")

    def __init__(self, text, linked, noise, article, heading, named=CLEAR, item=False):
        self.text, self.linked, self.noise, self.article = text, linked, noise, article
        self.heading, self.named, self.item = heading, named, item  # heading: its level, 0 for others; item: of a list


def name_says(word: str) -> int:
    """What a class or id, such as site-footer or legal-analysis, says."""
    parts = NAME_PARTS.findall(word)
    noise = [p for p in parts if p in NOISE_NAMES]
    if not noise or (len(parts) > 1 and not AROUND.isdisjoint(parts)):
        return CLEAR
    if any(p not in NOISE_NAMES and p not in GENERIC for p in parts):
        return MENTIONS
    return READERS if all(p in COMMENT_NAMES for p in noise) else NAMED


def _element(name: str, attributes: str, in_article: bool) -> tuple[bool, bool, int]:
    """Whether an element is noise by its tag or role, whether it holds an article, and what its names say."""
    noise = name in NOISE_TAGS or (name == "header" and not in_article)
    article, says = name == "article", CLEAR
    if attributes:
        for key, a, b, c, hidden in ATTRIBUTE.findall(attributes):
            value = (a or b or c).lower()
            key = key.lower()
            if hidden or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
                noise = True
            elif key == "role":
                noise = noise or value in NOISE_ROLES
                article = article or value in ("article", "main")
            elif key in ("class", "id"):
                if name not in ("html", "body", "main"):
                    found = max(map(name_says, value.split()), default=CLEAR)
                    says = max(says, found if name != "article" or found == READERS else CLEAR)
                if ARTICLE_NAMES.search(value):
                    article = True
            elif key == "itemprop" and value == "articlebody":
                article = True
    return noise, article and not noise and says < NAMED, says


def blocks(page: str) -> tuple[list[Block], bool]:
    """The blocks of a page that hold text, and whether some lie in an article.

    A part named as noise around the page's main element is none, nor is one around its article: where no article stands
    outside noise, one that holds more text than all blocks outside."""
    out, marked, inside = _blocks(page, ("main",))
    if not marked and inside:
        lifted, found, _ = _blocks(page, ("main", "article"))
        if found and sum(len(b.text) for b in lifted if b.article and not b.noise and b.named < NAMED) > sum(len(b.text) for b in out if not b.noise and b.named < NAMED):
            return lifted, found
    return out, marked


def _blocks(page: str, lifts: tuple[str, ...]) -> tuple[list[Block], bool, bool]:
    """blocks(), where elements named in lifts undo the names of the div and section elements around them; and whether an
    article stands in an element named as noise."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, int, int]] = []  # (name, noise, article, blocks before it, what its names say)
    inside = False
    texts: list[str] = []
    noise = article = anchor = main = items = 0
    says = [0, 0, 0, 0]  # how many open elements say what
    linked = 0
    heading = 0
    mains: list[int] = []

    def flush():
        nonlocal linked, heading
        if texts:
            text = " ".join(html.unescape("".join(texts)).split())
            texts.clear()
            if text:
                if main:
                    mains.append(len(out))
                named = READERS if says[READERS] else NAMED if says[NAMED] else MENTIONS if says[MENTIONS] else CLEAR
                out.append(Block(text, min(1.0, linked / len(text)), noise > 0, article > 0, heading, named, items > 0))
        linked, heading = 0, 0

    def close(depth: int):
        nonlocal noise, article, anchor, main, items
        while len(stack) > depth:
            name, n, a, _, named = stack.pop()
            noise -= n
            article -= a
            says[named] -= 1
            anchor -= name == "a"
            main -= name == "main"
            items -= name == "li"

    for m in PIECE.finditer(page):
        tag = m[3]
        if tag is None:
            t = m[0]
            if t[0] != "<" or t == "<":
                texts.append(t)
                if anchor:
                    linked += len(t.strip())
            elif m[1]:
                if m[1].lower() not in ("svg", "annotation", "annotation-xml", "noscript", "object", "canvas"):
                    flush()
            continue
        name = tag.lower()
        if name in INLINE:
            if name == "br":
                texts.append(" ")
            elif name == "a":
                if m[2]:
                    at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "a"), None)
                    if at is not None and at == len(stack) - 1:
                        close(at)
                    elif at is not None:
                        anchor -= 1
                        stack[at] = ("", *stack[at][1:])
                else:
                    stack.append(("a", False, False, len(out), CLEAR))
                    says[CLEAR] += 1
                    anchor += 1
            elif not m[2] and m[4] and ("class" in m[4] or "hidden" in m[4] or "style" in m[4]) and name == "span":
                n, _, named = _element(name, m[4], article > 0)
                if n or named >= NAMED:
                    flush()
                stack.append((name, n, False, len(out), named))
                noise += n
                says[named] += 1
            elif m[2] and name == "span" and stack and stack[-1][0] == "span":
                if stack[-1][1] or stack[-1][4] >= NAMED:
                    flush()
                close(len(stack) - 1)
            continue
        flush()
        if anchor and not m[2] and name != "a":  # a link that was never closed ends with its block
            anchor = 0
            stack[:] = [("", *s[1:]) if s[0] == "a" else s for s in stack]
        if m[2]:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if at is not None and not (name in ("p", "li", "div") and any(s[0] == "article" for s in stack[at + 1 :])):
                close(at)
            continue
        if name in VOID:
            continue
        if name in ("article", "main") and noise:
            close(0)  # a menu or header that was never closed ends where the article begins
        if name in ("p", "li", "dt", "dd", "option", "tr", "td", "th") or name in HEADINGS:
            while stack and (stack[-1][0] == "p" or stack[-1][0] == name or stack[-1][0] == ""):
                close(len(stack) - 1)
        elif stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        n, a, named = _element(name, m[4] or "", article > 0)
        if name in ("article", "main") and not n and (says[NAMED] or says[READERS]):
            inside |= name == "article"
            if name in lifts:
                for i, (other, was, holds, first, said) in enumerate(stack):
                    if said == NAMED and other in ("div", "section"):
                        stack[i] = (other, was, holds, first, CLEAR)
                        says[NAMED] -= 1
                        says[CLEAR] += 1
                        for b in out[first:]:
                            b.named = min(b.named, MENTIONS)
        stack.append((name, n, a, len(out), named))
        noise += n
        article += a
        says[named] += 1
        main += name == "main"
        items += name == "li"
        heading = int(name[1]) if name in HEADINGS else 0
    flush()
    under = 0  # the level of a heading after which readers' comments follow
    for b in out:
        if b.heading and (not under or b.heading <= under):
            under = b.heading if COMMENTS.match(b.text) else 0
        if under:
            b.named = READERS
    marked = any(b.article and not b.noise and b.named < NAMED for b in out)
    if not marked:
        for i in mains:
            out[i].article = True
        marked = any(b.article and not b.noise and b.named < NAMED for b in out)
    return out, marked, inside


def _stops(block: Block) -> float:
    """The share of stop words."""
    words = block.text.split()
    return sum(1 for w in words if w.strip(".,;:!?\"'()*%#&$|").lower() in STOP) / len(words)


def foreign(found: list[Block]) -> bool:
    """Whether the long blocks of a page mostly lack stop words, by characters."""
    long = [b for b in found if not b.noise and b.named < NAMED and b.linked <= LINKS and len(b.text) >= SHORT]
    return sum(len(b.text) for b in long if _stops(b) >= LOW) * 2 < sum(len(b.text) for b in long)


def first_pass(found: list[Block], marked: bool) -> list[int]:
    """GOOD, BAD, OPEN (short) or NEAR (nearly good) for each block."""
    unknown = not marked and foreign(found)  # stop words of the page's language aren't known
    # names count where text stands outside the parts that they name; else one of these is a wrapper around everything
    outside = marked or any(not b.noise and b.named < NAMED and b.linked <= LINKS and len(b.text) >= SHORT and (unknown or _stops(b) >= LOW) for b in found)
    links = [b.linked > LINKS for b in found]
    after_related = False
    out = []
    for i, b in enumerate(found):
        if b.heading:
            after_related = bool(RELATED.match(b.text))
        if b.noise or b.named == READERS or (b.named == NAMED and outside) or (marked and not b.article):
            out.append(BAD)
            continue
        n, stops = len(b.text), _stops(b)
        if links[i]:
            # in an article a link that stands alone may be a sentence of its own; several in a row are a menu
            row = any(0 <= j < len(found) and links[j] and (b.item or after_related) for j in (i - 1, i + 1))
            out.append(BAD if row or not marked else OPEN)
        elif marked:
            out.append(GOOD if n >= SHORT or stops >= HIGH else OPEN)
        elif after_related and b.heading:
            out.append(OPEN)
        else:
            more = 1.5 if b.named else 1.0  # names that mention noise ask for more
            if n < SHORT * more:
                out.append(OPEN)
            elif unknown or stops >= HIGH * more:
                out.append(GOOD if n >= LONG * more else NEAR)
            else:
                out.append(NEAR if stops >= LOW * more else BAD)
    return out


def second_pass(found: list[Block], labels: list[int], marked: bool) -> list[bool]:
    """Which blocks are kept."""
    n = len(found)
    before, after = [None] * n, [None] * n
    for order, to in ((range(n), before), (range(n - 1, -1, -1), after)):
        last = None
        for i in order:
            to[i] = last
            if labels[i] in (GOOD, BAD) and not (marked and (found[i].noise or found[i].named >= NAMED or not found[i].article)):
                last = i
    out = []
    for i, (b, label) in enumerate(zip(found, labels, strict=True)):
        if label in (GOOD, BAD):
            out.append(label == GOOD)
            continue
        sides = [(abs(j - i), labels[j]) for j in (before[i], after[i]) if j is not None]
        if not sides:
            out.append(True)  # nothing on the page speaks against it
        elif len({x for _, x in sides}) == 1:
            out.append(sides[0][1] == GOOD or (label == NEAR and len(sides) == 1))
        elif b.heading and after[i] is not None:
            out.append(labels[after[i]] == GOOD)
        else:
            out.append(label == NEAR or marked or min(sides)[1] == GOOD)
    return out


def main_text(page: str | None) -> str:
    """The good blocks of a page, in order, one to a line; nothing of a null or empty page."""
    if not page:
        return ""
    found, marked = blocks(page)
    kept = second_pass(found, first_pass(found, marked), marked)
    return "\n".join(b.text for b, k in zip(found, kept, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html, any others).

    text is never null: a null or empty page, or one without main text, has an empty one. Character references are
    decoded, runs of white space in a block become one space. Repeated rows come back as often as they came.
    """

    def run(batches):
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    bounded_batches(pages.sparkSession)
    types = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    out = pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {types['page_id']}, url {types['url']}, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
