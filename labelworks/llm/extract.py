"""Main text of web pages by a style tree per site."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelworks.llm.common import prepare, written

MIN_PAGES = 8  # a branch seen on fewer pages of a site is judged by its names alone
# Blocks of a branch below it are boilerplate. Names are a prior: text in a main element needs less, text
# named boilerplate needs content and presentation that both differ from page to page.
LEAST_IMPORTANCE = {"main": 0.3, "plain": 0.5, "noise": 0.95}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s>/]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|$)", re.S
)
_ATTRIBUTE = re.compile(r"(class|id|role|style|aria-hidden|hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

# Elements whose text is not content, those that begin a new block, and those without an end.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe"}
NOT_CONTENT = RAW | {"head", "nav", "footer", "aside", "form", "button", "select", "header", "dialog", "menu"}
VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "source", "area", "base", "col", "embed", "track", "param"}
INLINE = set("a abbr b bdi bdo cite code data dfn em font i kbd label mark q s samp small span strong sub sup time tt u var del ins".split())
MAIN = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Words in class, id and role that name boilerplate.
_NOISE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notice|alert|popup|modal|"
    r"newsletter|subscribe|subscription|signup|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side-bar|related|"
    r"recommended|widget|share|sharing|social|comments?|commentlist|disqus|respond|reply|replies|footer|header|"
    r"masthead|pagination|pager|toolbar|search|complementary|contentinfo)(?:$|[\s_-])",
    re.I,
)


def blocks_of(page: str | None) -> list[tuple[str, bool, bool, str]]:
    """Blocks of a page in order: (branch, boilerplate by name, inside a main element, text).

    The branch is the path of element names with first class names, as in ``body/div.ad``. What a browser
    does not show (head, hidden elements) is no block."""
    source = page or ""
    out: list[tuple[str, bool, bool, str]] = []
    stack: list[tuple[str, str, bool, bool, bool]] = []  # name, branch, boilerplate, main, hidden
    text: list[str] = []
    where = ("", False, False, False)

    def end_block() -> None:
        words = html.unescape("".join(text)).split()
        text.clear()
        if words and not where[3]:
            out.append((*where[:3], " ".join(words)))

    at = 0
    while at < len(source):
        m = _TOKEN.search(source, at)
        text.append(source[at : m.start() if m else len(source)])
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            names = [s[0] for s in stack]
            if name in names:
                if name not in INLINE:
                    end_block()
                del stack[len(names) - 1 - names[::-1].index(name) :]
        elif name in RAW:
            close = re.compile(f"</{re.escape(name)}\\s*>", re.I).search(source, at)
            at = close.end() if close else len(source)
            continue
        elif name == "br":
            text.append(" ")
            continue
        elif name in VOID:
            if name == "hr":
                end_block()
            continue
        else:
            facts = {}
            if m[3].strip():
                for key, a, b, c in _ATTRIBUTE.findall(m[3]):
                    facts[key.lower()] = a or b or c
            if name in INLINE and not facts:
                continue
            if name not in INLINE:
                end_block()
                # A new block ends an open paragraph; an item ends the item before it.
                open_names = [s[0] for s in stack]
                ends = {"p"} if name not in ("li", "dt", "dd", "tr", "td", "th", "option") else {"p", name}
                for e in ends:
                    if e in open_names:
                        i = len(open_names) - 1 - open_names[::-1].index(e)
                        if e == "p" or not {"ul", "ol", "table", "dl"} & set(open_names[i:]):
                            del stack[i:]
                            open_names = [s[0] for s in stack]
            above = stack[-1] if stack else ("", "", False, False, False)
            label = f"{facts.get('class', '')} {facts.get('id', '')} {facts.get('role', '')}"
            hidden = (
                above[4]
                or name == "head"
                or "hidden" in facts
                or re.search(r"display\s*:\s*none", facts.get("style", ""), re.I)
            )
            main = above[3] or name in MAIN or facts.get("role", "").lower() == "main"
            named = bool(_NOISE.search(label)) and name not in ("body", "html")
            silent = facts.get("aria-hidden", "").lower() == "true"
            noise = above[2] or silent or named or (name in NOT_CONTENT and not (name == "header" and above[3]))
            first = (facts.get("class") or "").split()[:1]
            branch = f"{above[1]}/{name}" + (f".{first[0]}" if first else "")
            stack.append((name, branch, noise, main, bool(hidden)))
        top = stack[-1] if stack else ("", "", False, False, False)
        if not text or not "".join(text).strip():
            where = top[1:]
        elif name not in INLINE:
            where = top[1:]
    end_block()
    return out


def content_of(page: str | None, importance: dict[str, float]) -> str:
    """The blocks that are content. The importance of a block's branch decides, against the value of
    ``LEAST_IMPORTANCE`` for its names. Branches without importance are judged by names alone: boilerplate
    goes, and text outside main elements goes where text inside one stays."""
    blocks = blocks_of(page)
    keeps = []
    for branch, noise, main, _ in blocks:
        known = importance.get(branch)
        if known is not None:
            keeps.append(known >= LEAST_IMPORTANCE["noise" if noise else "main" if main else "plain"])
        else:
            keeps.append(False if noise else True if main else None)
    in_main = any(k and b[2] for k, b in zip(keeps, blocks))
    return "\n".join(b[3] for k, b in zip(keeps, blocks) if k or (k is None and not in_main))


def main_text(page: str | None, unimportant: set[str]) -> str:
    """``content_of`` where nothing but some unimportant branches is known of the site."""
    return content_of(page, dict.fromkeys(unimportant, 0.0))


def listing():
    @F.pandas_udf("array<struct<branch: string, feature: long, children: long, first: boolean>>")
    def list_branches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            out = []
            for p in pages:
                seen: dict[str, list[int]] = {}
                for branch, _, _, t in blocks_of(p):
                    seen.setdefault(branch, []).append(crc32(t.encode("utf-8", "surrogatepass")))
                out.append(
                    [
                        {"branch": b, "feature": f, "children": len(fs), "first": i == 0}
                        for b, fs in seen.items()
                        for i, f in enumerate(dict.fromkeys(fs))
                    ]
                )
            yield pd.Series(out)

    return list_branches


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, branch, importance) over the merged trees of each site, of all blocks of all pages; equal
    pages of a site count once.

    Content: a feature (the text of a block) that k of the m pages of a branch have in common has entropy
    log k / log m; 1 less the mean over blocks is the importance of their content. Presentation: the
    entropy of the numbers of blocks that pages have in the branch. Importance is 0.9 times the former
    plus 0.1 times the latter. Branches on fewer than ``MIN_PAGES`` pages are left out.
    """
    rows = pages.select("host", F.xxhash64("html").alias("page"), F.explode(listing()("html")).alias("b"))
    rows = written(rows.select("host", "page", "b.*").distinct(), "branches")  # read twice; pages are parsed once
    per_feature = rows.groupBy("host", "branch", "feature").agg(F.count("*").alias("k"))
    per_style = rows.filter("first").groupBy("host", "branch", "children").agg(F.count("*").alias("k"))
    # A site has few branches and numbers of blocks against its pages.
    sizes = per_style.groupBy("host", "branch").agg(
        F.sum("k").alias("m"), F.sum(F.col("k") * F.log("k")).alias("k_log_k")
    ).filter(F.col("m") >= MIN_PAGES)
    log_m = F.log("m")
    # -sum(k/m log(k/m)) = log m - sum(k log k) / m
    presentation = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("k_log_k") / F.col("m") / log_m))
    content = per_feature.groupBy("host", "branch").agg(
        (F.sum(F.col("k") * F.log("k")) / F.sum("k")).alias("mean_log_k")
    )
    importance = 0.9 * (1 - F.least(F.lit(1.0), F.col("mean_log_k") / log_m)) + 0.1 * presentation
    return content.join(sizes, ["host", "branch"]).select("host", "branch", importance.alias("importance"))


def taking():
    @F.pandas_udf("string")
    def take(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for pages, branches, importance in batches:
            yield pd.Series(
                [
                    content_of(p, dict(zip(b, i)) if b is not None else {})
                    for p, b, i in zip(pages, branches, importance)
                ],
                dtype=object,
            )

    return take


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null and empty html give an empty text, as do pages without content. Pages without a url form a site
    of their own. Repeated rows get equal texts. An empty table gives an empty result; other columns are
    not read.
    """
    prepare(pages.sparkSession)
    base = pages.select(
        "page_id",
        "url",
        F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit("")).alias("host"),
        "html",
    )
    found = written(
        style_tree(base)
        .groupBy("host")
        .agg(F.sort_array(F.collect_list(F.struct("branch", "importance"))).alias("known")),
        "style-trees",
    )
    return (
        base.join(found, "host", "left")
        .select("page_id", "url", taking()("html", "known.branch", "known.importance").alias("text"))
        .withColumn("n_chars", F.length("text").cast("long"))
    )
