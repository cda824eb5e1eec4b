"""Rules over page trees (``sources/tree``): noise marks, the walk for text blocks, roots and their refinement.

All are windows and equi joins by page.  A rule about ancestors is a running maximum of
their last descendants; a rule about descendants the difference of a running count between
an element and its last descendant, which one join by page and number fetches.  Counts
that only the tags below decide come with the tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions.rules import is_valid_text
from textloom.functions.text import INVISIBLE, strip
from textloom.operators import ledger
from textloom.sources.tree import DIRECT, INLINE

PAGE = "page_id"
c = F.col


def order() -> WindowSpec:
    return W.partitionBy(PAGE).orderBy("node_id")


def upto() -> WindowSpec:
    return order().rowsBetween(W.unboundedPreceding, 0)


# fixed values: elements that are walked past, table parts, noise by meaning, what prose stands beside
SKIPPED = (
    "html head body title meta link base script style noscript iframe template slot embed object param video audio track source picture map area input textarea "
    "code pre kbd samp var tt table thead tbody tfoot tr td th caption col colgroup dt"
).split()
TABLES = "table thead tbody tfoot tr td th caption col colgroup".split()
MEANT_AS_NOISE = "footer aside nav search dialog address".split()
PROSE_FLOW = "p h1 h2 h3 h4 h5 h6 ul ol blockquote pre figure table picture".split()
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
# fixed values: characters that elements of noise may hold at most, a long aside, levels of wrappers, a headline's length
SAFE_CHARS, LONG_ASIDE, WRAPPERS, HEADLINE = 5000, 200, 6, (5, 199)
# fixed values: words within class names
META_WORDS = r"(^|[\s_-])(meta|author|byline|category|categories|dateline)([\s_-]|$)"
CONTENT_WORDS = r"(^|[\s_-])(post|content|article|story|entry|rich)([\s_-]|$)"
ARTICLE_CLASSES = "article-content article-body article-text story-content story-body story-text main-content content-body content-area post-content entry-content page-content".split()
BODY_CLASSES = "article-body article-content article-text story-body story-content post-content post__content".split()
LOW_PRIORITY = r"\bad\b|banner|sponsor|\bpromo\b|affiliate|\bshare\b|\bsocial\b|comment|related|recommend|sidebar|\bnavbar\b|site-nav|global-nav|\btopbar\b|subscribe|newsletter|\bcookie\b|\bconsent\b"
OVERLAY_CLASS = (
    r"\bcookie\b|\bconsent\b|\bgdpr\b|privacy-banner|cookie-banner|\bpopup\b|\bmodal\b|overlay|\bdialog\b|backdrop|lightbox|subscription-popup|paywall|subscribe-popup|newsletter-modal|"
    r"notification|subscribers|\bonetrust\b|\bot-sdk\b|\bot-pc\b|\bot-floating\b|\botfloatingflat\b"
)
OVERLAY_ID = r"\bcookie\b|\bconsent\b|\bgdpr\b|privacy|\bpopup\b|\bmodal\b|overlay|\bdialog\b|notification|subscribers|\bonetrust\b"
CONSENT_ID = r"onetrust|cookiebot|trustarc|quantcast|consent|gdpr|cookielaw|cookie-law|cookie|privacy"
CONSENT_CLASS = r"onetrust|\bot-sdk|ot-pc|ot-cookie|cookiebot|trustarc|quantcast|qc-cmp|cookie-banner|consent-banner|gdpr-banner|privacy-banner|\bcookies?\b"
SHARE = r"(^|[\s_-])(shares?|shared|social|sharing|sharethis|addthis)([\s_-]|$)"
HEADER_LIKE = r"article[_-]?header|post[_-]?header|entry[_-]?header|page[_-]?title|hero"
NO_WRAPPER = r"nav|menu|sidebar|footer|header|comment|widget"
# fixed values: class names of noise, by family (each word of the second list behind or, where it reads so, before the first) and alone
NOISE_FAMILIES = {
    "ad": "container slot wrapper panel frame box inner holder banner placeholder label unit widget area div code block content outer",
    "cookie": "consent banner notice policy table settings bar box modal container popup overlay wrapper law disclaimer management accept compliance control div",
    "consent": "banner container modal overlay popup wrapper",
    "gdpr": "banner consent modal overlay mask",
    "privacy": "policy notice pref popup modal info",
    "comment": "list section area module wrapper body content form reply thread holder entry",
    "search": "form box bar input wrapper widget container results",
    "newsletter": "signup form subscribe popup overlay modal",
    "related": "posts articles content carousel stories",
    "social": "share icons icon-list share-list",
    "share": "buttons menu list icons toolbar",
    "login": "form box bar",
    "user": "area menu profile rating",
}
NOISE_ALONE = (
    "sidebar side-bar nav-menu main-menu navigation-menu mobile-nav footer footer-wrap post-footer site-footer footnote copyright site-header site-top top-bar topbar masthead site-branding site-logo header-top header-main breadcrumb byline post-meta "
    "author-box widget-area signup-form register-form registration membership email-signup advertisement adsbygoogle advert advertorial sponsored promoted affiliate commercial leaderboard taboola outbrain mgid consent gdpr privacy onetrust klaro cmp "
    "optin disclaimer popup-overlay modal-dialog modal-backdrop more-stories also-read read-next read-more readmore reading-list more-from comments-area commentlist discussion pagination pager paging page-nav nav-links post-navigation toc "
    "table-of-contents language-switcher tagcloud tag-list category-list captcha recaptcha hcaptcha turnstile post-date entry-date published-date posted-on updated-on star-rating poll voting survey exit-popup notranslate"
).split()


def noise_classes() -> list[str]:
    return sorted({*NOISE_ALONE, *(f"{first}-{second}" for first, words in NOISE_FAMILIES.items() for second in words.split())})


def _named(names: list[str]) -> str:
    """A pattern of lower-cased class lists: a class that is one of ``names``, or begins or ends with it at a - or _."""
    any_of = "|".join(names)
    return rf"(^|\s)((\S*[-_])?({any_of})(?=\s|$)|({any_of})[-_])"


def _is(names: list[str]) -> Column:
    return F.concat(F.lit(" "), F.regexp_replace("class", r"\s+", " "), F.lit(" ")).rlike(" (" + "|".join(names) + ") ")


def low() -> Column:
    return F.lower("class")


def direct_tag() -> Column:
    return c("tag").isin(*DIRECT)


def block() -> Column:
    """A block element, or one that is declared a paragraph."""
    return direct_tag() | (F.coalesce(c("declared"), F.lit("")) == "p") | low().contains("public-draftstyledefault-block")


def short() -> Column:
    return c("text_chars") <= SAFE_CHARS


def below(flag: Column) -> Column:
    """Whether an ancestor has ``flag``."""
    return F.coalesce(F.max(F.when(flag, c("last"))).over(order().rowsBetween(W.unboundedPreceding, -1)) >= c("node_id"), F.lit(False))


def with_counts(nodes: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """``nodes`` with the number of descendants that have each flag."""
    running = nodes.withColumns({f"_{k}": F.count_if(flag).over(upto()) for k, flag in flags.items()})
    ends = running.select(PAGE, c("node_id").alias("last"), *[c(f"_{k}").alias(f"_{k}_end") for k in flags])
    return running.join(ends, [PAGE, "last"]).withColumns({k: c(f"_{k}_end") - c(f"_{k}") for k in flags}).drop(*[f"_{k}" for k in flags], *[f"_{k}_end" for k in flags])


def hidden() -> Column:
    style = F.lower("style")
    return c("hidden") | style.rlike(r"display\s*:\s*none|visibility\s*:\s*hidden")


def overlay() -> Column:
    style = F.lower("style")
    hint = F.concat_ws(" ", "class", "dom_id").rlike("(?i)banner|bar|toast|notice|alert")
    fixed = (c("tag") == "div") & (style.contains("position:fixed") | style.contains("position: sticky")) & hint
    return low().rlike(OVERLAY_CLASS) | F.lower("dom_id").rlike(OVERLAY_ID) | c("role").isin("dialog", "alertdialog") | fixed


def low_priority() -> Column:
    """Needs the count ``headings``."""
    named = low().rlike(LOW_PRIORITY) | F.lower("dom_id").rlike(LOW_PRIORITY)
    return c("tag").isin("nav", "footer", "aside") | F.when(c("tag") == "header", c("headings") == 0).otherwise(named)


def noise_by_class() -> Column:
    return low().rlike(_named(noise_classes())) & short()


def consent() -> Column:
    """A consent dialogue, itself or by an ancestor below the body.

    Of an element and its ancestors the nearest that is named like one decides: it counts unless it holds more
    than ``SAFE_CHARS`` characters."""
    named = ~c("tag").isin("body", "html") & (F.lower("dom_id").rlike(CONSENT_ID) | low().rlike(CONSENT_CLASS))
    # if the nearest is long, so are those above it: that one of them is short says the same
    return (named & short()) | below(named & short())


def marks(nodes: DataFrame) -> DataFrame:
    """Flags of every element: hidden, overlay, low_priority, noise, metadata, consent, removed."""
    in_article = below(c("tag") == "article")
    style = F.lower("style")
    named_fixed = low().rlike(r"\b(fixed|sticky)\b")
    held = style.contains("position:fixed") | style.contains("position: sticky")
    bottom = low().rlike(r"\bbottom-0\b|\binset-x-0\s+bottom") | style.rlike(r"bottom\s*:\s*0")
    shared = F.lower(F.concat_ws(" ", "class", "dom_id")).rlike(SHARE) & (named_fixed | style.rlike(r"\b(fixed|sticky)\b"))
    removed = below(c("tag") == "body") & ((c("tag").isin("aside", "dialog") & ~in_article) | ((named_fixed | held) & bottom) | shared)
    metadata = low().rlike(META_WORDS) & ~c("tag").isin("article", "main") & ~(c("tag").isin("section", "div") & low().rlike(CONTENT_WORDS))
    return nodes.withColumns({
        "is_hidden": hidden(), "overlay": overlay(), "low_priority": ~overlay() & low_priority(), "noise": noise_by_class(), "metadata": metadata, "consent": consent(), "removed": removed,
    })


def walk_facts(nodes: DataFrame) -> DataFrame:
    """What the rules of the walk ask about ancestors, siblings and descendants, besides ``marks``."""
    counted = marks(nodes)
    articles = c("tag").isin("article") | c("role").isin("article", "main") | low().rlike(_named(ARTICLE_CLASSES))
    region = c("tag").isin("article", "main") | c("role").isin("main", "article") | low().rlike(CONTENT_WORDS)
    siblings = F.count_if(c("tag").isin(*PROSE_FLOW)).over(W.partitionBy(PAGE, "parent_id"))
    flow = (c("parent_id") >= 0) & (siblings - c("tag").isin(*PROSE_FLOW).cast("int") > 0)
    chrome = below(c("tag").isin("nav", "footer", "dialog"))
    facts = counted.withColumns({"inside_article": articles | below(articles), "block_above": below(block()), "prose_flow": flow, "in_region": below(region), "in_chrome": chrome})
    plain = ~low().rlike(LOW_PRIORITY) & ~F.lower("dom_id").rlike(LOW_PRIORITY)
    aside = (c("tag") == "aside") & ~c("in_chrome") & plain & (c("in_region") | c("prose_flow")) & ((c("trimmed_chars") >= LONG_ASIDE) | (c("prose_flow") & (c("structure_inside") > 0)))
    return facts.withColumns({"content_aside": aside, "valid": F.coalesce(is_valid_text(block_text(c("text"))), F.lit(False))})


def block_text(text: Column) -> Column:
    """Without white space and invisible characters at its ends."""
    return strip(text, INVISIBLE)


def verdict(tables: bool = False) -> Column:
    """(kind, reason) of an element by the first rule that holds: ``reject`` with all below it, ``skip`` it
    alone, ``accept`` it.  ``tables``: parts of tables are walked."""
    said = lambda kind, reason: F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"))
    nested = ((c("tag") == "body") & (c("parent_id") != 0)) | ((c("tag") == "html") & (c("parent_id") > 0))
    skipped = c("tag").isin(*(t for t in SKIPPED if not (tables and t in TABLES))) & ~nested
    kept_apart = _is(["notranslate"]) | F.coalesce(c("editable").isin("true", ""), F.lit(False))
    return (
        F.when(c("tag").isin("svg", "math"), said("reject", "namespace"))
        .when(skipped | kept_apart, said("reject", "tag"))
        .when(c("is_hidden"), said("reject", "hidden"))
        .when(c("consent"), said("reject", "consent"))
        .when(c("noise") & c("tag").isin("article", "main"), said("skip", "noise"))
        .when(c("noise"), said("reject", "noise"))
        .when(c("metadata"), said("reject", "metadata"))
        .when((c("tag") == "header") & (c("headings") > 0), said("skip", "header"))
        .when(c("tag") == "header", said("reject", "header"))
        .when(c("content_aside"), said("skip", "aside"))
        .when(c("tag").isin(*MEANT_AS_NOISE), said("reject", "meaning"))
        .when(direct_tag() & (c("direct_inside") > 0), said("skip", "holds blocks"))
        .when(block() & c("valid"), said("accept", "block"))
        .when(block(), said("skip", "text"))
        .when(c("wide_child"), said("skip", "container"))
        .when((c("direct_text") | c("filled_child")) & c("valid"), said("accept", "lines"))
        .otherwise(said("skip", "text"))
    )


def walk(nodes: DataFrame, roots: DataFrame, tables: bool = False) -> DataFrame:
    """Elements below each page's root (``roots``: page_id, node_id) with ``verdict``; rejects are inherited."""
    root = roots.select(PAGE, c("node_id").alias("root_id"))
    ends = nodes.select(PAGE, c("node_id").alias("root_id"), c("last").alias("root_last")).join(root, [PAGE, "root_id"])
    inner = walk_facts(nodes).join(ends, PAGE).where((c("node_id") > c("root_id")) & (c("node_id") <= c("root_last"))).withColumn("own", verdict(tables))
    # what stands in an accepted block belongs to it
    closed = (c("own.kind") == "reject") | ((c("own.kind") == "accept") & (c("own.reason") == "block"))
    inherited = F.struct(F.lit("reject").alias("kind"), F.lit("inherited").alias("reason"))
    return inner.withColumn("verdict", F.when(below(closed), inherited).otherwise(c("own"))).drop("own", "root_last")


def headings_above(rows: DataFrame) -> DataFrame:
    """``rows`` of a walk with ``outline``: the walked headings at or before an element that no later one of the same or a higher level ends."""
    walked = c("verdict.kind") != "reject"
    at = {f"_h{k}": F.max(F.when(walked & (c("tag") == f"h{k}"), F.struct("node_id", block_text(c("text")).alias("text")))).over(upto()) for k in range(1, 7)}
    place = lambda k: F.coalesce(c(f"_h{k}.node_id"), F.lit(-1))
    open_ = [F.when((place(k) >= 0) & (place(k) > (F.greatest(F.lit(-1), *[place(j) for j in range(1, k)]) if k > 1 else F.lit(-1))), c(f"_h{k}.text")) for k in range(1, 7)]
    return rows.withColumns(at).withColumn("outline", F.array_compact(F.array(*open_))).drop(*at)


def blocks(nodes: DataFrame, roots: DataFrame, tables: bool = False) -> DataFrame:
    """(page_id, node_id, tag, path, text, outline, in_list): the blocks of a walk; of equal texts the first.

    A block element or a declared paragraph as a whole, an element within a line only where it stands in an
    article without a block around it, any other one that has text of its own and no container in it."""
    rows = headings_above(walk(nodes, roots, tables)).where(c("verdict.kind") == "accept")
    line = c("tag").isin(*INLINE) & ~block()
    kept = F.when(block(), F.lit(True)).when(line, c("inside_article") & ~c("block_above")).otherwise(c("direct_text"))
    texts = rows.where(kept).withColumn("text", block_text(c("text"))).where(c("text") != "")
    first = ledger.latest(texts, [PAGE, "text"], [c("node_id")])
    return first.select(PAGE, "node_id", "tag", "path", "text", "outline", (c("tag") == "li").alias("in_list"))


def page_blocks(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``blocks``, and for pages without one those of a walk through tables, with ``by_tables``."""
    plain = ledger.checkpointed(blocks(nodes, roots).withColumn("by_tables", F.lit(False)))
    bare = roots.join(plain.select(PAGE).distinct(), PAGE, "left_anti")
    return plain.unionByName(blocks(nodes.join(bare.select(PAGE), PAGE), bare, tables=True).withColumn("by_tables", F.lit(True)))


# ---- roots


def headline_below(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``headline``: whether the first h1 below has the length of a headline."""
    nxt = F.min(F.when(c("tag") == "h1", F.struct("node_id", "trimmed_chars"))).over(order().rowsBetween(1, W.unboundedFollowing))
    return nodes.withColumn("_h1", nxt).withColumn("headline", F.coalesce((c("_h1.node_id") <= c("last")) & c("_h1.trimmed_chars").between(*HEADLINE), F.lit(False))).drop("_h1")


def container_scores(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``container_score``: what speaks for an element as the article's root, from what stands in it."""
    flags = {
        "h1s": c("tag") == "h1", "h2s": c("tag") == "h2", "ps": c("tag") == "p", "figures": c("tag").isin("img", "figure"), "authors": (c("rel") == "author") | _is(["author", "byline"]) | c("class").contains("author"),
        "times": (c("tag") == "time") | c("class").contains("date") | c("class").contains("publish"), "navs": c("tag").isin("nav", "footer", "header") | _is(["menu", "sidebar"]),
        "buttons": (c("tag") == "button") | ((c("tag") == "a") & _is(["btn"])), "relateds": c("class").contains("related") | c("class").contains("recommend"), "lis": c("tag") == "li",
    }
    # fixed values: the points of each sign
    score = (
        F.when(c("h1s") == 1, 20.0).when(c("h1s") > 1, -10.0).otherwise(0.0) + F.when(c("h2s") >= 2, 10).otherwise(0) + F.least(F.lit(30.0), c("trimmed_chars") / 800) + F.least(F.lit(20), c("ps"))
        + F.least(F.lit(5), c("figures")) + F.when(c("authors") > 0, 8).otherwise(0) + F.when(c("times") > 0, 6).otherwise(0) - 8 * c("navs")
        - F.when(c("buttons") > 10, 15).otherwise(0) - F.when(c("relateds") > 0, 8).otherwise(0) - F.when(c("lis") > 80, 10).otherwise(0)
    )
    return with_counts(nodes, flags).withColumn("container_score", score).drop(*flags)


def _on_page(nodes: DataFrame, picks: DataFrame) -> DataFrame:
    """Every element of a page beside its pick (``pick_id``, ``pick_last`` and so on): one pick a page."""
    own = nodes.select(PAGE, c("node_id").alias("pick_id"), c("last").alias("pick_last"), c("tag").alias("pick_tag"), c("parent_id").alias("pick_parent"), _is(BODY_CLASSES).alias("pick_is_body"))
    return nodes.join(own.join(picks.select(PAGE, c("node_id").alias("pick_id")), [PAGE, "pick_id"]), PAGE)


def around() -> Column:
    """Of ``_on_page``: ancestors of the pick."""
    return (c("node_id") < c("pick_id")) & (c("last") >= c("pick_last"))


def within() -> Column:
    """Of ``_on_page``: descendants of the pick."""
    return (c("node_id") > c("pick_id")) & (c("node_id") <= c("pick_last"))


def refined_roots(nodes: DataFrame, picks: DataFrame) -> DataFrame:
    """(page_id, node_id): a body element gives way to the article around it, and another pick to the body element
    in it, unless a heading of the article stands outside the body element: then the article is the root."""
    side = _on_page(nodes.select(PAGE, "node_id", "parent_id", "last", "tag", "class"), picks)
    rank = F.coalesce(*[F.when(_is([k]), F.lit(i)) for i, k in enumerate(BODY_CLASSES)])
    near = side.groupBy(PAGE, "pick_id", "pick_last", "pick_tag", "pick_is_body").agg(
        F.max(F.when(around() & (c("tag") == "article"), F.struct("node_id", "last"))).alias("article"),
        F.min(F.when(within() & _is(BODY_CLASSES), F.struct(rank.alias("order"), c("node_id"), c("last")))).alias("inner"),
    )
    # the larger and the smaller of two nested elements, of which one will be the root
    pick = F.struct(c("pick_id").alias("node_id"), c("pick_last").alias("last"))
    inner = F.when(c("inner").isNotNull(), F.struct(c("inner.node_id").alias("node_id"), c("inner.last").alias("last")))
    pairs = near.select(
        PAGE, "pick_is_body", "pick_tag", F.when(c("pick_is_body"), c("article")).otherwise(pick).alias("outer"), F.when(c("pick_is_body"), pick).otherwise(inner).alias("inside")
    )
    heading = c("tag").isin("h1", "h2") & (c("trimmed_chars") >= 4)
    outside = (c("node_id") > c("outer.node_id")) & (c("node_id") <= c("outer.last")) & ~c("node_id").between(c("inside.node_id"), c("inside.last"))
    said = nodes.join(pairs, PAGE).groupBy(PAGE, "pick_is_body", "pick_tag", "outer", "inside").agg(F.coalesce(F.bool_or(heading & outside), F.lit(False)).alias("headed"))
    up = c("headed") & (c("pick_is_body") | (c("pick_tag") == "article"))
    return said.select(PAGE, F.when(c("inside").isNull(), c("outer.node_id")).when(c("outer").isNull() | ~up, c("inside.node_id")).otherwise(c("outer.node_id")).alias("node_id"))


def unwrapped_roots(nodes: DataFrame, picks: DataFrame) -> DataFrame:
    """(page_id, node_id): up through at most ``WRAPPERS`` elements that add no text; only a pick's ancestors are looked at."""
    passes = ~c("tag").isin("body", "html") & ~F.concat_ws(" ", "class", "dom_id").rlike(f"(?i){NO_WRAPPER}")
    slim = nodes.select(PAGE, "node_id", "parent_id", "last", "tag", "class", "trimmed_chars", passes.alias("passes"))
    line = _on_page(slim, picks).where(around() | (c("node_id") == c("pick_id")))
    up = W.partitionBy(PAGE).orderBy(c("node_id").desc())
    step = (c("node_id") == c("pick_id")) | (c("passes") & (c("trimmed_chars") <= F.lag("trimmed_chars").over(up)) & ~c("pick_is_body"))
    # an element of the article's body stays; of the others the way ends at the first step that is none
    steps = line.withColumns({"step": step, "up": F.row_number().over(up) - 1}).where(c("up") <= WRAPPERS)
    whole = F.min(c("step").cast("int")).over(up.rowsBetween(W.unboundedPreceding, 0)) == 1
    return steps.withColumn("whole", whole).where("whole").groupBy(PAGE).agg(F.min("node_id").alias("node_id"))


def best_roots(nodes: DataFrame, picks: DataFrame) -> DataFrame:
    """(page_id, node_id): the element or the ancestor, up to the first with a headline, that scores best; the nearest of equal ones."""
    slim = nodes.select(PAGE, "node_id", "parent_id", "last", "tag", "class", "rel", "trimmed_chars")
    side = _on_page(container_scores(headline_below(slim)), picks)
    line = side.where((around() | (c("node_id") == c("pick_id"))) & ~c("tag").isin("body", "html"))
    stop = F.max(F.when(c("headline"), c("node_id"))).over(W.partitionBy(PAGE))
    asked = line.withColumn("stop", F.coalesce(stop, F.lit(-1))).where(c("node_id") >= c("stop"))
    best = asked.groupBy(PAGE).agg(F.max(F.struct("container_score", "node_id")).alias("best")).select(PAGE, c("best.node_id").alias("better"))
    return picks.select(PAGE, "node_id").join(best, PAGE, "left").select(PAGE, F.coalesce("better", "node_id").alias("node_id"))


def with_headers(nodes: DataFrame, picks: DataFrame) -> DataFrame:
    """(page_id, node_id, expanded): the parent of a root without an h1 that a header with a heading precedes."""
    slim = nodes.select(PAGE, "node_id", "parent_id", "last", "tag", "class", "headings")
    side = _on_page(slim, picks)
    header = ((c("tag") == "header") | low().rlike(HEADER_LIKE)) & (c("headings") > 0)
    said = side.groupBy(PAGE, "pick_id", "pick_parent").agg(
        F.bool_or(within() & (c("tag") == "h1")).alias("titled"), F.bool_or((c("parent_id") == c("pick_parent")) & (c("node_id") < c("pick_id")) & header).alias("headed")
    )
    grown = ~c("titled") & c("headed") & (c("pick_parent") >= 0)
    return said.select(PAGE, F.when(grown, c("pick_parent")).otherwise(c("pick_id")).alias("node_id"), grown.alias("expanded"))


# fixed values: class names of roots in their order of preference, with the elements among them
ROOT_SELECTORS = [
    *[("class", k) for k in "article-body article-content article-text story-body story-content u-rich-text-blog rich-text post-content post__content entry-content page-content blog-content".split()],
    ("tag", "article"), ("role", "article"), ("role", "main"), ("tag", "main"), ("class", "main-content"), ("class", "content-body"),
]


def selected_roots(nodes: DataFrame) -> DataFrame:
    """(page_id, node_id): the longest element of the first selector that finds one with text."""
    tests = [F.when(_is([value]) if kind == "class" else c(kind) == value, F.lit(i)) for i, (kind, value) in enumerate(ROOT_SELECTORS)]
    # an element may fit several selectors: each is asked by itself
    rows = nodes.where(c("trimmed_chars") > 0).select(PAGE, "node_id", "trimmed_chars", F.explode(F.array_compact(F.array(*tests))).alias("selector"))
    return ledger.latest(rows, [PAGE], [c("selector"), c("trimmed_chars").desc(), c("node_id")]).select(PAGE, "node_id")


def article_roots(nodes: DataFrame) -> DataFrame:
    """(page_id, node_id): selected, refined, unwrapped, the best ancestor, with the header before it; else the body."""
    picked = best_roots(nodes, unwrapped_roots(nodes, refined_roots(nodes, selected_roots(nodes))))
    grown = with_headers(nodes, picked).select(PAGE, "node_id")
    body = nodes.where(c("tag") == "body").groupBy(PAGE).agg(F.min("node_id").alias("node_id")).join(grown.select(PAGE), PAGE, "left_anti")
    return grown.unionByName(body.select(PAGE, "node_id"))


# ---- scores that rise from paragraphs

# fixed values: class words for and against, characters of a paragraph, share for a grandparent
FOR = r"(?i)article|body|content|entry|main|page|post|text|blog|story"
AGAINST = r"(?i)comment|footer|meta|nav|sidebar|sponsor|widget|promo|related|share|banner|masthead|menu"
PARAGRAPH, DAMPED = 25, 0.5


def risen_scores(nodes: DataFrame) -> DataFrame:
    """(page_id, node_id, score) of elements whose paragraphs speak for them.

    A paragraph of ``PARAGRAPH`` characters has a point, one for each comma and one for each hundred characters up to
    three; its parent gets all, its grandparent ``DAMPED`` of it.  Class and id add or take 25, and the share of text
    that is in links takes its part."""
    commas = F.char_length("text") - F.char_length(F.regexp_replace("text", "[,，、]", ""))
    said = nodes.where(c("tag").isin("p", "pre", "td") & (c("trimmed_chars") >= PARAGRAPH)).select(
        PAGE, "node_id", "parent_id", (1 + F.coalesce(commas, F.lit(0)) + F.least(F.lit(3), F.floor(c("trimmed_chars") / 100))).alias("points")
    )
    ups = nodes.select(PAGE, c("node_id").alias("parent_id"), c("parent_id").alias("grandparent"))
    both = said.join(ups, [PAGE, "parent_id"]).select(
        PAGE, F.explode(F.array(F.struct(c("parent_id").alias("node_id"), c("points").cast("double").alias("points")), F.struct(c("grandparent").alias("node_id"), (c("points") * DAMPED).alias("points")))).alias("s")
    )
    risen = both.select(PAGE, "s.node_id", "s.points").where(c("node_id") >= 0).groupBy(PAGE, "node_id").agg(F.sum("points").alias("points"))
    dense = nodes.withColumn("density", F.when(c("text_chars") > 0, c("link_chars") / c("text_chars")).otherwise(0.0))
    sign = lambda name: F.when(c(name).rlike(AGAINST), -25).otherwise(0) + F.when(c(name).rlike(FOR), 25).otherwise(0)
    tag = F.when(c("tag").isin("div", "article", "main", "section"), 5).when(c("tag").isin("pre", "td", "blockquote"), 3).when(c("tag").isin("ol", "ul", "dl", "form", "li"), -3).otherwise(0)
    found = dense.where(~c("tag").isin("html", "body")).join(risen, [PAGE, "node_id"])
    return found.select(PAGE, "node_id", "tag", F.round((c("points") + tag + sign("class") + sign("dom_id")) * (1 - F.least(F.lit(1.0), c("density"))), 6).alias("score"))


def readability_roots(nodes: DataFrame) -> DataFrame:
    """(page_id, node_id, tag, score): the element with the highest risen score, where it is above nothing."""
    best = risen_scores(nodes).where(c("score") > 0).groupBy(PAGE).agg(F.max(F.struct("score", (-c("node_id")).alias("order"), "tag")).alias("b"))
    return best.select(PAGE, (-c("b.order")).alias("node_id"), c("b.tag").alias("tag"), c("b.score").alias("score"))
