"""HTML main-text extraction by equivalence classes of template tokens over the pages of a host, and rules of page regions.

1. A page is a row of tokens: tags with the path of open elements to them (their role), and text blocks with
   the role of the block; copies of a page on a host count once. A token's occurrence vector holds its count on every page of the host; it is represented by
   the number of pages, the total count, and a sum over pages of a hash of (page, count), so that vectors are compared
   without being kept.
2. Tokens of a host with equal vectors, on at least ``SUPPORT`` of its pages, are an equivalence class: an odd page or a
   second layout doesn't end a template. A class's region is the path that its tokens share; classes nest by their
   regions and are kept outermost first, in the order of their places. Together they are the host's template: its tags
   are the frame, its blocks (slogans, labels, notices) are fixed text.
3. What a template leaves open are slots, the regions of the frame. Those in page furniture (by element, or by words of class,
   id and role) are furniture; the article slot is a marked article or main region if the frame has one, else the deepest
   region with most text per page over the host. Blocks of the page inside it, without the template's fixed ones, are its
   main text. A page that marks an article itself is read by its mark. Words of class and id decide only while text is left
   without them: where all text of a page lies in elements so named, elements alone count as furniture.

The grouping into classes orders and nests the template; the texts follow from the support of the tokens: the blocks of every
class are fixed, whatever the class, and slots are regions of the tags on each page once, not gaps between a class's tokens.

A host of fewer than ``FEW`` pages has too few to tell fixed text from chance and has no template; the same rules of regions apply.

Scale: one parsing scan of the pages for the templates and one for the texts, and others that only hash them. Tokens are
counted within a task before the shuffle. Only those on at least half of the pages of a host that a task counts at a time
leave it: a token with the support of a template is such a one somewhere. Where others of those parts, which didn't send
it, leave open whether it has the support, or lack a part of its vector, the pages of its host are read again for exactly these
tokens (``recounted``), so that every count of a template is the whole one. Templates are written (a row for each host of ``FEW`` pages or more) and joined by
host: as the size of the files is known when the join is planned, Spark broadcasts them below its threshold, and else
shuffles the pages and splits hot hosts.

Nulls: null and empty html give an empty text, a null url the empty host; repeated rows of a page count as one page and are extracted alike; markup
that never closes is closed where its parent is; paths longer than ``LONGEST_ROLE`` characters and nesting deeper than
``DEEPEST`` keep their outer part; ties between regions go to the deeper, then the later name; very long texts are parsed whole; an empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from claimforge.llm.io import materialise

HALF, SUPPORT = 0.5, 0.8
VECTOR = 0xFFFFFFFFFF
FEW = 4
LONGEST_ROLE, DEEPEST = 400, 500
LONGEST_FIXED = 300  # characters; longer blocks stand in tokens by their hash
FLUSH_PAGES, HELD = 4000, 400_000  # a task counts so many pages, or different tokens, at a time
SOFT, HARD = 1, 2

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_LEAF = re.compile(r"^(p|h[1-6]|li|dt|dd|pre|td|th|tr|blockquote|caption|figcaption)([.]|$)")  # a piece of text, no region
_ATTR = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden|style|type)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes svg math".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption option""".split())
#: An opening tag of the key closes an open element of the values (up to a border).
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}, "p": {"p"}}
_CLOSES_P = _BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend", "summary", "li", "dd", "dt"} | {"li", "dd", "dt"}
_BORDER = frozenset("table ul ol dl menu select button div section article main aside nav header footer form blockquote fieldset figure details body html".split())
_FURNITURE = frozenset("nav header footer aside form button select menu dialog template object audio video canvas input label search".split())
_FURNITURE_WORDS = frozenset("""ad ads adv advert advertisement advertising adbox banner sponsor sponsored promo promotion nav navbar navigation menu
breadcrumb breadcrumbs header masthead footer sidebar side rail aside widget cookie cookies consent gdpr notice notification alert popup modal overlay
comment comments disqus reply replies respond discussion share sharing social related recommended recommendations newsletter subscribe subscription signup login search
pagination pager toolbar skip copyright legal disclaimer paywall hidden form""".split())
_ARTICLE_WORDS = frozenset("article post entry story".split())
_FURNITURE_STEMS = ("comment", "advert", "cookie", "sidebar", "breadcrumb", "newsletter", "sponsor", "disqus")
_NOT_FURNITURE = frozenset(("commentary",))
#: What makes even an article element no article: a reader's comment, a teaser, an advert.
_NO_ARTICLE = frozenset("comment comments reply replies related recommended teaser promo ad ads sponsored widget".split())
#: Words that name furniture alone or beside one of the second list; beside others they may be part of a matter (share price).
_WEAK = frozenset("share social side rail skip legal notice alert search form reply respond related recommended header label menu subscription login comment".split())
_COMPANIONS = frozenset("""bar bars box boxes button buttons link links list lists icon icons area section container wrapper wrap block panel pane content column col
left right top bottom main inner outer row group item items slot unit text title heading field input post posts article articles story stories news us this page site count tools
fixed sticky small large primary secondary thread body author meta""".split())
_HEADER_OF_ARTICLE = frozenset(("article", "main"))


@lru_cache(maxsize=65536)
def _split_words(value: str) -> frozenset:
    parts = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
    return frozenset(parts)


def _furniture_words(token: str) -> frozenset:
    """Words of one class or id that name furniture: a weak one doesn't beside a word of some matter."""
    words = _split_words(token)
    found = words & _FURNITURE_WORDS
    matter = words - _FURNITURE_WORDS - _COMPANIONS
    return found - _WEAK if matter else found


@lru_cache(maxsize=65536)
def _kind(tag: str, attrs: str) -> tuple[str, int, bool, bool]:
    """(signature of the tag for its role, furniture: HARD by element, SOFT by words, 0 none; article?, a block?)."""
    names, hidden, role, tokens_ = [], False, "", []
    if attrs:
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), (a or b or c)
            if name in ("class", "id", "itemprop"):
                names.append(value)
                tokens_ += value.split()
            elif name == "role":
                role = value.lower()
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                hidden = True
    words = frozenset().union(*(_split_words(n) for n in names)) if names else frozenset()
    stems = {w for w in words if w.startswith(_FURNITURE_STEMS)} - _NOT_FURNITURE
    marked = frozenset().union(*(_furniture_words(t) for t in tokens_)) if tokens_ else frozenset()
    marked = marked - ({"header"} if words & _ARTICLE_WORDS else set()) | stems
    by_words = words & _NO_ARTICLE | stems if tag in ("article", "main") else set() if tag in ("body", "html") else marked
    furniture = HARD if hidden or tag in _FURNITURE or role in {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"} else SOFT if by_words else 0
    article = not by_words and (tag in ("article", "main") or role in ("main", "article") or "articlebody" in "".join(names).lower().replace("-", "").replace("_", ""))
    sig = tag + ("." + ".".join(sorted(words)) if words else "")
    return sig, furniture, article, tag in _BLOCKS


class Page:
    """Blocks and tags of a page, in order, each with the path (role) of its open elements."""

    __slots__ = ("blocks", "roles")

    def __init__(self) -> None:
        self.blocks: list[tuple[str, str, int, bool]] = []  # (role, text, furniture, inside an article)
        self.roles: list[str] = []


def parse(source: str) -> Page:
    page, text, pos, n = Page(), [], 0, len(source)
    stack: list[tuple[str, str, int, bool, bool]] = [("", "", 0, False, True)]  # tag, role, furniture, article, block

    def flush() -> None:
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if joined:
                # the block belongs to the innermost open block element
                for _, role, furniture, article, block in reversed(stack):
                    if block:
                        break
                page.blocks.append((role, joined, max(s[2] for s in stack), article))

    def close(to: int) -> None:
        if any(s[4] for s in stack[to:]):
            flush()
        del stack[to:]

    find = _TOKEN.search
    while pos < n:
        m = find(source, pos)
        if m is None:
            text.append(source[pos:])
            break
        if m.start() > pos:
            text.append(source[pos : m.start()])
        pos = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            if tag == "p" and not any(s[0] == "p" for s in stack):
                flush()
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if stack[k][0] in ("article", "main", "body") and tag not in ("article", "main", "body", "html"):
                    break
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(source, pos)
            pos = end.end() if end else n
            continue
        attrs = m.group(3) or ""
        if tag == "br":
            text.append(" ")
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            elif tag == "img" or tag == "input":
                text.append(" ")
            continue
        closes = _CLOSES.get(tag, set()) | ({"p"} if tag in _CLOSES_P else set())
        if closes:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in closes:
                    close(k)
                    break
                if stack[k][0] in _BORDER:
                    break
        sig, furniture, article, block = _kind(tag, attrs.strip())
        if tag == "header" and any(s[0] in _HEADER_OF_ARTICLE for s in stack):
            furniture = 0  # the heading of an article, not of the page
        if block:
            flush()
        if attrs.endswith("/") and not block:
            continue
        parent = stack[-1]
        # formatting that never closes must not deepen the roles without end
        role = parent[1] if not block else parent[1] + "/" + sig
        if block and len(role) > LONGEST_ROLE:
            role = parent[1]
        stack.append((tag, role, furniture, article or parent[3], block))
        if block:
            page.roles.append(role)
        if len(stack) > DEEPEST:
            del stack[DEEPEST // 2 :]
    flush()
    return page


def tokens(page: Page) -> Counter:
    """Occurrences of a page's template candidates: tags with their roles, and text blocks with theirs."""
    out = Counter("<" + r for r in page.roles)
    out.update(block_token(role, text) for role, text, _, _ in page.blocks)
    return out


def block_token(role: str, text: str) -> str:
    return role + ">" + (text if len(text) <= LONGEST_FIXED else "\0" + xxhash.xxh3_128_hexdigest(text.encode("utf-8", "surrogatepass")))


def host_of(url) -> str:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m.group(1).lower() if m else ""


def host_column():
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def distinct_pages(pages: DataFrame) -> DataFrame:
    """One page of each content of a host: copies must not make content look fixed."""
    p = pages.filter("length(html) > 0").select("page_id", "url", "html", host_column().alias("_host"), F.xxhash64("html").alias("_content"))
    rows = p.groupBy("_host", "_content", "page_id").agg(F.count(F.lit(1)).alias("rows"))
    first = rows.groupBy("_host", "_content").agg(F.min(F.struct("page_id", "rows")).alias("f")).select(F.col("_host").alias("h"), F.col("_content").alias("c"), F.col("f.page_id").alias("id"), F.col("f.rows").alias("rows"))
    own = p.join(materialise(first, "page-contents"), (F.col("_host") == F.col("h")) & (F.col("_content") == F.col("c")) & F.col("page_id").eqNullSafe(F.col("id")))
    return own.select("page_id", "url", "html", (1 / F.col("rows")).alias("weight"))


COUNTED = "host string, token string, pages double, total double, vector long, first double, host_pages double, chars double"


def occurrences(pages: DataFrame, wanted: bool = False) -> DataFrame:
    """Per task and host: tokens on at least half of its pages with their counts and vector sums; token '' has the host's pages.
    With ``wanted``, the tokens in the pages' column of that name instead, on however many pages."""

    def run(it):
        names = [c.split()[0] for c in COUNTED.split(", ")]
        kinds = [pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        state: dict[str, dict] = defaultdict(dict)
        count, chars, only = Counter(), defaultdict(Counter), {}

        def flush():
            rows = []
            for host, own in state.items():
                least = 0 if wanted else HALF * count[host]
                if not wanted:
                    rows.append((host, "", count[host], 0, 0, 0.0, count[host], 0))
                for t, (p, total, vector, first) in own.items():
                    if p >= least:
                        signed = vector & VECTOR  # 40 bits, so that the sum over eight million tasks stays within a long
                        rows.append((host, t, p, total, signed, first, 0 if wanted else count[host], chars[host].get(t[1:], 0) if t[0] == "<" else 0))
            for kept in (state, count, chars, only):
                kept.clear()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        done = held = 0
        for b in it:
            lists = b.column("wanted") if wanted else [None] * b.num_rows
            for pid, url, source, part, asked in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), b.column("html"), b.column("weight").to_pylist(), lists, strict=True):
                source = source.as_py()
                if not source:
                    continue
                host, page = host_of(url), parse(source)
                if wanted and host not in only:
                    only[host] = frozenset(asked.as_py())
                own, seed = state[host], hash_page(pid)
                held -= len(own)
                count[host] += part  # rows of one page make one together
                for place, (t, c) in enumerate(tokens(page).items()):
                    if wanted and t not in only[host]:
                        continue
                    p, total, vector, first = own.get(t, (0, 0, 0, 0.0))
                    own[t] = (p + part, total + c * part, (vector + mix_count(seed, c)) & VECTOR, first + place * part)
                held += len(own)
                for role, text, furniture, _ in page.blocks:
                    if not furniture:
                        at = role
                        while at:
                            chars[host][at] += len(text) * part
                            at = at.rpartition("/")[0]
                done += 1
                if done >= FLUSH_PAGES or held >= HELD:
                    yield from flush()
                    done = held = 0
        yield from flush()

    return pages.select("page_id", "url", "html", "weight", *(["wanted"] if wanted else [])).mapInArrow(run, COUNTED)


def summed(rows: DataFrame) -> DataFrame:
    """occurrences() of all tasks; ``host_pages`` of a token are the pages among which it was counted."""
    add = {c: F.sum(c) for c in ("pages", "total", "vector", "first", "host_pages", "chars")} | {"vector": F.pmod(F.sum("vector"), F.lit(VECTOR + 1))}
    return rows.groupBy("host", "token").agg(*[x.alias(c) for c, x in add.items()])


def recounted(pages: DataFrame, x: DataFrame) -> DataFrame:
    """The counts in x (host, token, ...) of tokens that can have a template's support, whole: with ``n``, the host's pages.

    A token that some part of the pages didn't send is on less than half of those pages. If it can reach the support with them,
    all pages of its host are read again for it.
    """
    sizes = x.filter("token = ''").select(F.col("host").alias("h"), F.col("host_pages").alias("n")).filter(F.col("n") > FEW - 0.5)
    least = F.col("n") * SUPPORT - 1e-6
    given = x.filter("token <> ''").join(sizes, F.col("host") == F.col("h")).drop("h").filter(F.col("pages") + (F.col("n") - F.col("host_pages")) * HALF > least)
    partly = F.col("host_pages") < F.col("n") - 1e-6
    asked = materialise(given.filter(partly).groupBy("host", "n").agg(F.collect_list("token").alias("wanted")), "tokens-open")
    if asked.isEmpty():
        return given.filter(F.col("pages") > least)
    names = asked.select(F.col("host").alias("h"), "wanted")
    again = distinct_pages(pages.select("page_id", "url", "html").join(names.select("h"), host_column() == F.col("h"), "left_semi"))
    again = summed(occurrences(again.join(names, host_column() == F.col("h")), wanted=True)).join(asked.select(F.col("host").alias("h"), "n"), F.col("host") == F.col("h")).drop("h")
    return given.filter(~partly).unionByName(materialise(again.select(*given.columns), "tokens-again")).filter(F.col("pages") > least)


def hash_page(pid) -> int:
    return xxhash.xxh64_intdigest(str(pid).encode())


def mix_count(seed: int, c: int) -> int:
    x = (seed ^ (c * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 31)) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
    return (x ^ (x >> 32)) & VECTOR


def templates(pages: DataFrame, least_class: int = 1) -> DataFrame:
    """(host, template): the valid equivalence classes of each host by position, and its article slot's role."""
    full = recounted(pages, materialise(summed(occurrences(distinct_pages(pages))), "tokens")).drop("host_pages")
    place, path = F.col("first") / F.col("pages"), F.split(F.when(F.col("token").startswith("<"), F.substring("token", 2, 1 << 20)).otherwise(F.substring_index("token", ">", 1)), "/")
    classes = full.groupBy("host", "n", F.round("total", 3).alias("total"), "vector").agg(F.sort_array(F.collect_list(F.struct(place.alias("place"), "token", "chars"))).alias("t"), F.round(F.max("pages"), 3).alias("on"), F.min(path).alias("low"), F.max(path).alias("high"))
    # the elements that the least and the greatest path share are shared by all between them
    same = F.filter(F.sequence(F.lit(1), F.least(F.size("low"), F.size("high"))), lambda i: F.slice("low", 1, i) == F.slice("high", 1, i))
    classes = classes.filter(F.size("t") >= least_class).withColumn("depth", F.size(same))
    classes = classes.select("host", "n", F.struct("depth", F.element_at("t.place", 1).alias("place"), F.size("t").alias("size"), F.col("on").alias("pages"), F.array_join(F.slice("low", 1, F.col("depth")), "/").alias("region"), F.col("t.token").alias("tokens"), F.col("t.chars").alias("chars"), (F.col("total") == F.col("on")).alias("once")).alias("c"))
    hosts = classes.groupBy("host", "n").agg(F.sort_array(F.collect_list("c")).alias("cs"))
    regions = F.flatten(F.transform("cs", lambda c: F.when(c.once, F.arrays_zip(c.tokens.alias("tokens"), c.chars.alias("chars"))).otherwise(F.array().cast("array<struct<tokens:string,chars:double>>"))))
    frame = F.filter(regions, lambda r: r.tokens.startswith("<"))
    nested = F.transform("cs", lambda c: F.struct(c.size.alias("size"), c.pages.alias("pages"), c.region.alias("region"), c.tokens.alias("tokens")))
    return hosts.withColumn("_frame", frame).select("host", F.struct(nested.alias("classes"), slot_of(F.col("_frame")).alias("slot"), F.round("n").cast("long").alias("pages")).alias("template"))


def slot_of(frame):
    """Role of the article slot: a marked article or main region of the frame, else the deepest region with nine tenths of the most text."""
    leaf = lambda r: F.element_at(F.split(r.tokens, "/"), -1)
    marked = F.filter(frame, lambda r: leaf(r).rlike("^(article|main)([.]|$)"))
    frame = F.filter(frame, lambda r: ~leaf(r).rlike(_LEAF.pattern))
    most = F.array_max(F.transform(frame, lambda r: r.chars))
    rich = F.filter(frame, lambda r: (r.chars * 10 >= most * 9) & (r.chars > 0))
    deepest = F.array_max(F.transform(rich, lambda r: F.struct(F.size(F.split(r.tokens, "/")).alias("d"), r.chars.alias("c"), r.tokens.alias("t"))))
    best = F.array_max(F.transform(marked, lambda r: F.struct(r.chars.alias("c"), r.tokens.alias("t"))))
    return F.substring(F.coalesce(F.when(F.size(marked) > 0, best["t"]), deepest["t"]), 2, 1 << 20)


def extract(source: str | None, fixed: frozenset, slot: str | None) -> str:
    """The main text of a page by its host's fixed tokens and article slot."""
    if not source:
        return ""
    page = parse(source)

    def is_fixed(role: str, text: str) -> bool:
        return block_token(role, text) in fixed

    inside = [b for b in page.blocks if b[3] and not b[2]]
    if not inside and slot:
        inside = [b for b in page.blocks if not b[2] and (b[0] == slot or b[0].startswith(slot + "/"))]
    for allowed in (0, SOFT):
        if not inside:
            inside = _densest([b for b in page.blocks if b[2] <= allowed])
    return "\n".join(text for role, text, _, _ in inside if not is_fixed(role, text))


def _densest(blocks: list) -> list:
    """Blocks below the deepest region that holds nine tenths of the text."""
    total, below = sum(len(b[1]) for b in blocks), Counter()
    for role, text, _, _ in blocks:
        at = role
        while at:
            below[at] += len(text)
            at = at.rpartition("/")[0]
    best = max((r for r, c in below.items() if 10 * c >= 9 * total and not _LEAF.match(r.rpartition("/")[2])), key=lambda r: (r.count("/"), r), default="")
    return [b for b in blocks if b[0] == best or b[0].startswith(best + "/")] if best else blocks


def main_text(pages: DataFrame, keep: tuple = ("url",)) -> DataFrame:
    """Per page: page_id, the columns in ``keep``, text, n_chars."""
    host = host_column()
    joined = pages.select(*dict.fromkeys(["page_id", "url", "html", *keep])).withColumn("_host", host).join(materialise(templates(pages), "templates").withColumnRenamed("host", "_h"), F.col("_host") == F.col("_h"), "left")
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def run(it):
        cache: dict[str, tuple] = {}
        for b in it:
            texts = []
            for host, source, t in zip(b.column("_host").to_pylist(), b.column("html"), b.column("template"), strict=True):
                if host not in cache:
                    if len(cache) > 2000:
                        cache.clear()
                    v = t.as_py()
                    fixed = frozenset(x for c in (v["classes"] if v else []) for x in c["tokens"] if x[0] != "<")
                    cache[host] = (fixed, v["slot"] if v else None)
                texts.append(extract(source.as_py(), *cache[host]))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), *[b.column(k) for k in keep], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", *keep, "text", "n_chars"])

    schema = f"page_id {kinds['page_id']}, " + "".join(f"`{k}` {kinds[k]}, " for k in keep) + "text string, n_chars long"
    return joined.select("page_id", *keep, "html", "_host", "template").mapInArrow(run, schema) if "html" not in keep else joined.mapInArrow(run, schema)
