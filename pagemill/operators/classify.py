"""Classifiers for pages, responses, links and sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markup import ANY_TAG, html_unescape, inside, visible
from ..functions.selectors import select
from ..functions.text import WHITESPACE, collapse_ws, let, strip_ws
from ..functions.urls import url_defrag, url_netloc, url_scheme
from ..session import reused
from .joins import salted_join
from .presets import PLATFORM_SIGNS, PRESETS

# Fixed values.
BLOCK_PHRASES = [
    "just a moment", "access denied", "attention required", "verify you are human",
    "are you a robot", "captcha", "request blocked", "pardon our interruption", "403 forbidden",
]
HARD_SITES = [
    "amazon.", "linkedin.com", "facebook.com", "instagram.com", "twitter.com", "x.com",
    "tiktok.com", "zillow.com", "booking.com", "airbnb.com", "tripadvisor.com", "yelp.com",
    "glassdoor.com", "indeed.com", "craigslist.org", "walmart.com", "target.com", "ebay.com",
]
FALLBACK_SELECTORS = [
    "tr.athing", "li.product", ".product-card", "article.product_pod", ".product-item",
    "article.card", "div.card", "li.card", "div[class*='product']", "div[class*='item']",
]
RESTRICTED = [401, 403, 429, 999]
BROWSER_REFUSED = [401, 403, 429, 503]
INTERACTIVE = r"(?i)<(?:a|input|button|select|textarea)\b"


# ---------------------------------------------------------------- pages and responses


def is_blocked(html: Column, within: int | None = None) -> Column:
    """Does the page hold a phrase of a block page; with ``within``, its title or that many of its
    first characters?"""
    phrases = "|".join(BLOCK_PHRASES)
    if within is None:
        return F.lower(html).rlike(phrases)
    title = F.lower(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.concat(title, F.lower(F.substring(html, 1, within))).rlike(phrases)


def visible_length(html: Column) -> Column:
    return F.length(collapse_ws(html_unescape(F.regexp_replace(visible(html), ANY_TAG, " "))))


def is_thin(html: Column) -> Column:
    """Few controls and little text: probably filled in by scripts."""
    few = F.regexp_count(html, F.lit(INTERACTIVE)) < 5
    return F.when(few, visible_length(html) < 200).otherwise(False)


def page_flags(pages: DataFrame) -> DataFrame:
    html = F.col("html")
    return pages.select("page_id", is_blocked(html).alias("blocked"), is_thin(html).alias("thin"))


def fetch_verdict(responses: DataFrame) -> DataFrame:
    """Adds ``usable`` and ``next_step`` to responses with ``status, html, mode``.

    mode 'auto' or 'static' is a plain request, 'headless' a rendered one.  The steps are use,
    fail, render and visible.
    """
    blocked, thin = is_blocked(F.col("html")), is_thin(F.col("html"))
    refused = blocked | F.col("status").isin(BROWSER_REFUSED)
    static = F.col("mode") == "static"
    plain = (F.col("status") < 400) & ~blocked & (static | ~thin)
    usable = F.when(F.col("mode") == "headless", ~refused).otherwise(plain)
    step = (
        F.when(F.col("usable"), "use")
        .when(F.col("mode") == "headless", "visible")
        .when(static, "fail")
        .otherwise("render")
    )
    return responses.withColumn("usable", F.coalesce(usable, F.lit(False))).withColumn(
        "next_step", step
    )


def detect_cms_column(html: Column) -> Column:
    """``struct<preset, score>``: best platform by summed weights, the first one on a tie."""

    def best(low: Column) -> Column:
        scores = []
        for order, (name, weight, patterns) in enumerate(PLATFORM_SIGNS):
            score = sum((F.when(low.rlike(p), weight).otherwise(0) for p in patterns), F.lit(0))
            scores.append(
                F.struct(
                    score.alias("score"), F.lit(-order).alias("order"), F.lit(name).alias("preset")
                )
            )
        return F.array_max(F.array(*scores))

    def known(b: Column) -> Column:
        found = (b.score > 0) & b.preset.isin(list(PRESETS))
        return F.struct(
            F.when(found, b.preset).otherwise("generic").alias("preset"),
            F.when(found, b.score).otherwise(0).alias("score"),
        )

    return let(let(F.lower(html), best), known)


def detect_cms(pages: DataFrame) -> DataFrame:
    found = pages.select("page_id", detect_cms_column(F.col("html")).alias("cms"))
    return found.select("page_id", "cms.preset", "cms.score")


# ---------------------------------------------------------------- links


def link_status(code: Column, error: Column) -> Column:
    return (
        F.when(error.isNotNull() & (error != ""), "ERROR")
        .when(code < 400, "OK")
        .when(code.isin(RESTRICTED), "RESTRICTED")
        .otherwise("BROKEN")
    )


def known_hard(url: Column) -> Column:
    """Reason text if the URL contains the name of a site known to block, else ''."""
    low = F.lower(url)
    hits = F.filter(F.array(*map(F.lit, HARD_SITES)), lambda h: F.contains(low, h))
    name = F.regexp_replace(F.get(hits, F.lit(0)), r"\.+$", "")
    return F.coalesce(F.concat(F.lit("known anti-bot site ("), name, F.lit(")")), F.lit(""))


# ---------------------------------------------------------------- robots.txt


def _decoded(path: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def robots_rules(body: Column) -> Column:
    """Rules of the first ``*`` group, in file order: ``array<struct<path, allow>>``."""

    def parsed(line: Column) -> Column:
        code = strip_ws(F.regexp_replace(line, "#.*$", ""))
        field = F.lower(strip_ws(F.regexp_extract(code, "^([^:]*):", 1)))
        value = _decoded(strip_ws(F.regexp_extract(code, "^[^:]*:(.*)$", 1)))
        return F.struct((line == "").alias("blank"), field.alias("field"), value.alias("value"))

    def step(acc: Column, line: Column) -> Column:
        agent = line.field == "user-agent"
        rule = line.field.isin("allow", "disallow") & (acc.mode > 0)
        pause = line.field.isin("crawl-delay", "request-rate") & (acc.mode > 0)
        closes = (line.blank | agent) & (acc.mode == 2)
        fresh = closes | (line.blank & (acc.mode == 1))
        star = F.when(fresh, False).otherwise(acc.star)
        allow = (line.field == "allow") | (line.value == "")
        added = F.array(F.struct(line.value.alias("path"), allow.alias("allow")))
        return F.struct(
            F.when(agent, 1).when(rule | pause, 2).when(line.blank, 0).otherwise(acc.mode).alias("mode"),
            (star | (agent & (line.value == "*"))).alias("star"),
            (acc.done | (closes & acc.star)).alias("done"),
            F.when(rule & acc.star & ~acc.done, F.concat(acc.rules, added))
            .otherwise(acc.rules)
            .alias("rules"),
        )

    zero = F.struct(
        F.lit(0).alias("mode"),
        F.lit(False).alias("star"),
        F.lit(False).alias("done"),
        F.array().cast("array<struct<path:string,allow:boolean>>").alias("rules"),
    )
    lines = F.transform(F.split(body, r"\r\n|\r|\n"), parsed)
    return F.aggregate(lines, zero, step, lambda acc: acc.rules)


def rules_allow(rules: Column, url: Column) -> Column:
    """First rule whose path starts the URL's path decides; no rule allows."""
    path = _decoded(F.regexp_extract(url_defrag(url), r"^[^:/?#]*://[^/?#]*(.*)$", 1))
    path = F.when(path == "", "/").otherwise(path)
    hits = F.filter(rules, lambda r: F.startswith(path, r.path))
    return F.coalesce(F.get(hits, F.lit(0)).allow, F.lit(True))


def robots_site(url: Column) -> Column:
    """``scheme://host``, the key of the robots table; null for other schemes."""
    http = url_scheme(url).isin("http", "https")
    return F.when(http, F.concat(url_scheme(url), F.lit("://"), url_netloc(url)))


def robots_allows(urls: DataFrame, robots: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``allowed`` to ``urls``.  ``robots`` has one row per ``site`` with ``status, body``; a
    missing row, another status than 200 and a scheme other than http(s) allow everything."""
    rules = robots.where("status = 200").select(
        F.col("site").alias("_site"), robots_rules(F.col("body")).alias("_rules")
    )
    keyed = urls.withColumn("_site", robots_site(F.col(url)))
    joined = salted_join(keyed, rules, "_site", "left")
    return joined.select(*urls.columns, rules_allow(F.col("_rules"), F.col(url)).alias("allowed"))


# ---------------------------------------------------------------- site audit


@reused
def signals_columns() -> dict[str, Column]:
    """Flags and counts that need only the tokens of a page."""
    tokens = F.col("tokens")
    counts = F.array_max(
        F.array(
            *[
                F.struct(
                    F.size(select(tokens, s)).alias("n"),
                    F.lit(-order).alias("order"),
                    F.lit(s).alias("selector"),
                )
                for order, s in enumerate(FALLBACK_SELECTORS)
            ]
        )
    )

    def only_string(a: Column) -> Column:
        """The string of an element that holds one string and nothing beside it."""
        below = inside(tokens, a)
        texts = F.filter(below, lambda t: t.tag == "")
        one = F.get(texts, F.lit(0))
        wraps = F.forall(
            below,
            lambda t: (t.tag == "") | t.tag.startswith("/") | ((t.pos < one.pos) & (one.pos <= t.end)),
        )
        return F.when((F.size(texts) == 1) & wraps, F.lower(strip_ws(one.raw)))

    def says_next(t: Column) -> Column:
        rel = F.array_contains(F.split(t.attrs["rel"], WHITESPACE + "+"), "next")
        named = only_string(t).isin("next", "next page", "more")
        return (t.tag == "a") & (F.coalesce(rel, F.lit(False)) | F.coalesce(named, F.lit(False)))

    def login(t: Column) -> Column:
        password = (t.tag == "input") & (t.attrs["type"] == "password")
        form = (t.tag == "form") & F.lower(t.attrs["action"]).contains("login")
        return F.coalesce(password, F.lit(False)) | F.coalesce(form, F.lit(False))

    def captcha(t: Column) -> Column:
        frame = (t.tag == "iframe") & F.lower(t.attrs["src"]).contains("recaptcha")
        return F.coalesce(frame, F.lit(False)) | F.lower(t.cls).contains("captcha")

    return {
        "fallback": counts,
        "has_next": F.exists(tokens, says_next),
        "has_login": F.exists(tokens, login),
        "has_captcha": F.exists(tokens, captcha),
    }


def page_signals(pages: DataFrame) -> DataFrame:
    """Signals of the audit: repeating blocks, known selectors, platform, next, login, captcha."""
    from .records import first, group_selector, groups_column, once, with_document

    tokens = F.col("tokens")
    doc = with_document(pages, cms=detect_cms_column(F.col("html")))
    doc = once(
        doc,
        ["page_id", "url", "tokens", "cms"],
        best=first(groups_column()),
        **signals_columns(),
    )
    n = F.col("fallback.n")
    return doc.select(
        "page_id",
        "url",
        F.coalesce(F.col("best.count"), F.lit(0)).alias("auto_items"),
        F.coalesce(group_selector(tokens, F.col("best")), F.lit("")).alias("auto_selector"),
        n.alias("fallback_items"),
        F.when(n > 0, F.col("fallback.selector")).otherwise("").alias("fallback_selector"),
        "cms.preset",
        F.col("cms.score").alias("preset_score"),
        "has_next",
        "has_login",
        "has_captcha",
    )


def verdict(signals: DataFrame) -> DataFrame:
    """Adds ``verdict, reason`` to signals with ``allowed`` (robots) and ``url``."""
    hard = known_hard(F.col("url"))
    auto, fallback = F.col("auto_items"), F.col("fallback_items")

    def answer(label: str, reason) -> Column:
        reason = F.lit(reason) if isinstance(reason, str) else reason
        return F.struct(F.lit(label).alias("verdict"), reason.alias("reason"))

    answers = (
        F.when(~F.col("allowed"), answer("DECLINE", "robots.txt disallows this path"))
        .when(
            hard != "",
            answer("HARD", F.concat(hard, F.lit(" — expected to block scraping after a few pages"))),
        )
        .when(F.col("has_captcha"), answer("DECLINE", "site uses CAPTCHA — unreliable to scrape"))
        .when(
            auto >= 10,
            answer("EASY", F.format_string("auto-detected %d items in the card block", auto)),
        )
        .when(
            fallback >= 10,
            answer(
                "MEDIUM",
                F.format_string(
                    "auto-detect failed but `%s` returns %d items", "fallback_selector", fallback
                ),
            ),
        )
        .when(F.col("has_login"), answer("HARD", "login-walled — needs --interactive --save-session"))
        .otherwise(answer("HARD", "could not find repeating items with common selectors"))
    )
    return signals.withColumn("_v", answers).select(*signals.columns, "_v.verdict", "_v.reason")


# ---------------------------------------------------------------- gates and report filters


def strict_gate(issues: DataFrame) -> DataFrame:
    """One row: number of High issues, and whether the run fails (exit code 3)."""
    high = F.count_if(F.col("severity") == "High")
    return issues.agg(high.alias("high")).select(
        "high",
        (F.col("high") > 0).alias("failed"),
        F.when(F.col("high") > 0, 3).otherwise(0).alias("exit_code"),
    )


def report_filter(df: DataFrame, query: str) -> DataFrame:
    """Rows whose cells, read as one text, contain the query in any letter case."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
    return df.where(F.lower(F.concat_ws(" ", *cells)).contains(query.lower()))
