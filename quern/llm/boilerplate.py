"""Problem 5: the main body of web pages, by wrapper induction per host.

Each page is a tree: its lines, below a line the parts of a menu or what stands behind a label. Trees of pages of one host (and
language) are aligned by simple tree matching, one after the other with the tree grown so far: what matches is merged, what doesn't is
inserted in its place. Labels are counted over all pages beforehand, and nodes on too few of them to become constant are left out of the
trees. Then every page is aligned with its host's tree, and the matches are counted over the whole corpus, before any shuffle within
each task. Nodes matched on enough pages are constant: they are the template. In a last pass
every page is aligned with the template of its host; what is matched is template, what varies lies in slots: a slot below a heading
that is followed by titles wherever it stands belongs to the furniture (teasers), any other is content. Subtrees that are constant over
the hosts of a language are matched wherever they stand on a page.
No task holds the pages of a host: only counts are grouped by host, pages stream past the tree of their host, and the trees that grow
in the parts of a large host are aligned with each other.
"""

from __future__ import annotations

import functools
import hashlib
import html
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.garbled import fit, label, text_fields
from quern.operators.skew import SALTS, hot_keys
from quern.sources import table, write_and_read

#: A node is constant if it is on this share of all pages in its language, or of its host's pages in it (of OWN_PAGES at least).
SHARE, OWN_SHARE, OWN_PAGES = 0.033, 0.5, 6
#: A rarer line is constant too if a page that has it shares it with so many of the other pages of its host and language (over all
#: hosts, with KEEPS_LEAST pages at least); on a host it must be on KEEPS_SHARE of the pages.
KEEPS, KEEPS_LEAST, KEEPS_SHARE = 0.2, 4, 0.02
#: A constant heading is followed by titles if the next line looks like one this often.
TITLES_AFTER = 0.8
#: As many titles may lie below such a heading as this share of its places has at most.
TITLES_SHARE = 0.98
#: A host and language with so many pages is divided into parts.
HOT_PAGES = 20_000
#: Different pages that a growing tree remembers, so as not to align equal ones again.
KNOWN = 10_000

# Labels of questions and answers, which are body wherever they stand.
_TALK = {"sual", "cavab", "soru", "cevap", "question", "answer", "вопрос", "ответ", "q", "a"}
_FURNITURE_TAGS = {"nav", "footer", "aside", "small", "form", "button", "a", "div", "span", "header"}
_BODY_TAGS = {"p", "h1", "h2", "blockquote", "td", "pre"}
_SEP = re.compile(r"\s+[|•·»→>/]\s+|\s{2,}|\t")
_TAG = re.compile(r"^\s*<(\w+)")


def site_columns(pages: DataFrame) -> DataFrame:
    """PAGES with host (without www and mobile prefix), word (of the site), lang (by the letters; good enough to compare like with like) and site."""
    url = F.lower("url")
    full = F.regexp_extract(url, r"^\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#:\s]+)", 1)
    host = F.regexp_replace(F.when(full != "", full).otherwise(F.regexp_extract(url, r"^\s*([^/?#:\s]+\.[a-z]+)", 1)), r"^(?:www|m)\.", "")
    words = F.split("host", r"\.")
    word = F.regexp_replace(F.coalesce(F.try_element_at(words, F.lit(-2)), F.get(words, F.lit(0))), r"\d+$", "")
    text = F.regexp_replace(F.coalesce("content", F.lit("")), "<[^>]*>|\\s", "")
    many = lambda letters, x: F.regexp_count(F.col("_t"), F.lit(letters)) > F.length("_t") * x
    lang = F.when(many("[а-яё]", 0.2), "ru").when(many("[əƏ]", 0.01), "az").when(many("[ığşİüçö]", 0.02), "tr").otherwise("en")
    out = pages.withColumn("host", host).withColumn("word", word).withColumn("_t", text).withColumn("lang", lang).drop("_t")
    return out.withColumn("site", F.concat_ws(" ", "host", "lang"))


def visible(line: str) -> str:
    return html.unescape(re.sub(r"<[^>]*>", "", line)).replace("\r", "").strip()


def node_key(text: str, site: str) -> str:
    """What makes nodes the same: lower case, numbers and the site's name replaced."""
    t = text.lower()
    if site:
        t = t.replace(site, "§")
    return re.sub(r"\s+", " ", re.sub(r"\d+(?:[ .,]\d+)*", "0", t)).strip(" ​-")


def _parts(text: str) -> list[str]:
    parts = [p for p in (x.strip() for x in _SEP.split(text)) if p]
    return parts if len(parts) > 1 else []


def _prefix(text: str) -> str:
    m = re.match(r"([^:.!?]{2,30}):\s", text + " ")
    return m.group(1).lower().strip() if m and not text.rstrip().endswith(".") and m.group(1).lower().strip() not in _TALK else ""


def title_like(text: str) -> bool:
    """The shape of a heading: short, begins with a capital, no full stop, not a list item."""
    return 0 < len(text) <= 95 and not text.endswith((".", "!", "…")) and (text[0].isupper() or text[0] in "«“\"'") and not re.match(r"[-•*]|\d+[.)]", text) and ". " not in text


def bare_title(title: str, site: str) -> str:
    """A page's title without the site's name behind it."""
    t = visible(title or "")
    m = re.match(r"(.*\S)\s+[|—–-]\s+(.+)$", t, re.S)
    if m and site and (site in m.group(2).lower() or len(m.group(2)) <= 20):
        return m.group(1)
    return t


#: A tree: its label and its children.
Tree = tuple[str, tuple]
_MENU = "|"


@functools.lru_cache(50_000)
def _line(raw: str, site: str) -> tuple[str, str, str, Tree]:
    """(visible text, tag, key, node) of a line; furniture comes again and again, so the last ones are kept."""
    text = visible(raw)
    tag = m.group(1).lower() if (m := _TAG.match(raw)) else ""
    key = node_key(text, site)
    if (p := _prefix(text)) and not _parts(p):
        rest = text.lstrip()[len(p) + 1 :]
        node = f"{p}:", tuple((node_key(w, site), ()) for w in _parts(rest) or [rest])
    else:
        words = _parts(text)
        node = (_MENU, tuple((node_key(w, site), ()) for w in words)) if words else (key, ())
    return text, tag, key, node


class Page:
    """The tree of one page: a node per line with visible text."""

    def __init__(self, content: str, title: str, site: str) -> None:
        lines = [_line(x, site) for x in content.split("\n")]
        self.text = [x[0] for x in lines]
        self.tag = [x[1] for x in lines]
        self.key = [x[2] for x in lines]
        self.lines = [i for i, k in enumerate(self.key) if k]
        self.own = node_key(bare_title(title, site), site)
        self.nodes = [lines[i][3] for i in self.lines]

    def titles_after(self, j: int) -> int:
        """How many lines behind the node J look like titles, one after the other."""
        n = 0
        for i in self.lines[j + 1 :]:
            if not title_like(self.text[i]) or self.key[i] == self.own or _parts(self.text[i]):
                break
            n += 1
        return n

    def matched(self, tree: list[Tree]) -> list[tuple[str, str, float, int]]:
        """(kind, key, place, titles behind it) of each different node that simple tree matching pairs with one of the host's TREE."""
        out: dict[tuple[str, str], tuple[float, int]] = {}
        for j, k in matching(self.nodes, tree)[1]:
            (label, children), key = self.nodes[j], self.key[self.lines[j]]
            if len(children) > 1:
                for x, _ in matching(children, tree[k][1])[1]:
                    out.setdefault(("part", children[x][0]), (float(x), 0))
            if children and label != _MENU:
                out.setdefault(("prefix", label), (j / len(self.nodes), 0))
            if not children or matching(children, tree[k][1])[0] == len(children):
                out.setdefault(("line", key), (j / len(self.nodes), self.titles_after(j)))
        return [(kind, key, *v) for (kind, key), v in out.items()]


def matching(a: Sequence[Tree], b: Sequence[Tree]) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two lists of sibling trees: the size of the largest order-preserving matching and the pairs of siblings in it.

    Only pairs with equal labels are looked at; the best chain of pairs that ends before a place is kept in a tree of maxima.
    """
    at: dict[str, list[int]] = {}
    for j, y in enumerate(b):
        at.setdefault(y[0], []).append(j)
    best: list[tuple] = [(0, None)] * (len(b) + 1)
    for i, x in enumerate(a):
        new = []
        for j in at.get(x[0], ()):
            weight = 1 + (matching(x[1], b[j][1])[0] if x[1] and b[j][1] else 0)
            before, k = (0, None), j
            while k:
                if best[k][0] > before[0]:
                    before = best[k]
                k -= k & -k
            new.append((j + 1, (before[0] + weight, (i, j, before[1]))))
        for k, chain in new:
            while k <= len(b):
                if chain[0] > best[k][0]:
                    best[k] = chain
                k += k & -k
    top, k = (0, None), len(b)
    while k:
        if best[k][0] > top[0]:
            top = best[k]
        k -= k & -k
    pairs, link = [], top[1]
    while link:
        pairs.append(link[:2])
        link = link[2]
    return top[0], pairs[::-1]


def simple_tree_match(a: Tree, b: Tree) -> int:
    """The size of the largest matching of two trees that keeps order and ancestors."""
    return 1 + matching(a[1], b[1])[0] if a[0] == b[0] else 0


def grow(tree: list[Tree], page: Sequence[Tree]) -> list[Tree]:
    """TREE after PAGE is aligned with it: matched nodes are merged, others inserted behind the match before them."""
    pairs = dict(matching(page, tree)[1])
    out, behind, last = list(tree), {}, -1
    for i, node in enumerate(page):
        if i in pairs:
            last = pairs[i]
            if node[1]:
                out[last] = (node[0], tuple(grow(list(out[last][1]), node[1])))
        else:
            behind.setdefault(last, []).append(node)
    return [n for k in range(-1, len(out)) for n in ([out[k]] if k >= 0 else []) + behind.get(k, [])]


def labels_of(page: Sequence[Tree]) -> set[str]:
    return {n[0] for n in page} | {c[0] for n in page for c in n[1]}


def reduced(page: Sequence[Tree], keep: Callable[[str], bool]) -> tuple[Tree, ...]:
    """PAGE without the nodes and parts whose labels aren't to KEEP."""
    kept = [(n[0], tuple(c for c in n[1] if keep(c[0]))) for n in page if keep(n[0])]
    return tuple(n for n in kept if n[1] or n[0] != _MENU)


def host_tree(pages: Sequence[Sequence[Tree]]) -> list[Tree]:
    """The tree of a host, grown from PAGES. Nodes on a single one of them can't match and are left out beforehand."""
    seen = Counter(x for p in pages for x in labels_of(p))
    tree: list[Tree] = []
    for p in pages:
        tree = grow(tree, reduced(p, lambda x: seen[x] > 1))
    return tree


class Template:
    """The constant nodes of a host: its tree without the others, and what is constant in the whole language."""

    def __init__(self, tree: list[Tree], nodes: list[tuple[str, str, float, float, int, bool]]) -> None:
        """NODES: (kind, key, place, share of titles behind it, most titles, everywhere)."""
        self.line = {k: (after, most) for kind, k, _, after, most, _ in nodes if kind == "line"}
        parts = {k for kind, k, *_ in nodes if kind != "prefix"}
        self.prefix = {k for kind, k, *_ in nodes if kind == "prefix"}
        kept = [(n[0], tuple(c for c in n[1] if c[0] in parts) if len(n[1]) > 1 else n[1]) for n in tree]
        self.tree = [n for n in kept if n[0] in self.line or n[0] in self.prefix or n[1] and (n[0] == _MENU or len(n[1]) > 1 or f"{n[0]} {n[1][0][0]}" in self.line)]
        self.anywhere = {k for kind, k, *_, every in nodes if kind == "line" and every}
        self.menu_parts = {k for kind, k, *_, every in nodes if kind != "prefix" and every}

    def furniture(self, page: Page) -> dict[int, tuple[float, int]]:
        """The nodes of PAGE that are template, with the share of titles behind them and their number."""
        out = {}
        pairs = dict(matching(page.nodes, self.tree)[1])
        for j, (label, children) in enumerate(page.nodes):
            key = page.key[page.lines[j]]
            if key in self.line and (j in pairs or key in self.anywhere):
                out[j] = self.line[key]
            elif children and label in self.prefix:
                out[j] = (0.0, 0)
            elif len(children) > 1:
                hits = {x for x, _ in matching(children, self.tree[pairs[j]][1])[1]} if j in pairs else set()
                hits |= {x for x, c in enumerate(children) if c[0] in self.menu_parts}
                if 0 in hits or 2 * len(hits) > len(children):
                    out[j] = (0.0, 0)
        return out


def template_lines(page: Page, template: Template) -> list[int]:
    """The numbers (from 1) of the lines that aren't body."""
    constant = template.furniture(page)
    out: set[int] = set()
    heading_seen = False
    has_own = any(page.key[i] == page.own for i in page.lines)
    below, left = False, 0  # below a heading of teasers
    for j, i in enumerate(page.lines):
        k, text, tag = page.key[i], page.text[i], page.tag[i]
        own = k == page.own and not heading_seen and tag not in ("a",)
        if own:
            heading_seen, below = True, False
        elif j in constant and k.rstrip(":") not in _TALK:
            out.add(i)
            after, left = constant[j]
            below = after >= TITLES_AFTER
        elif tag in _FURNITURE_TAGS:
            out.add(i)
            left -= 1
        elif below and left > 0 and title_like(text) and tag not in _BODY_TAGS:
            out.add(i)
            left -= 1
        else:
            below = False
    body = [i for i in page.lines if i not in out]
    if not has_own and not any(len(page.text[i]) >= 90 or page.text[i].count(". ") >= 1 and len(page.text[i]) >= 60 for i in body):
        out.update(page.lines)  # a page without a body: not found, log in
    return [i + 1 for i in sorted(out)]


def pages_of(knowledge_base: DataFrame) -> DataFrame:
    """(kb_id, url, title, content) of the rows that are web pages; rows stored twice under one id count once."""
    web = knowledge_base.where(F.col("source_url").isNotNull() & (F.trim("source_url") != "") & F.col("content").isNotNull())
    return web.select(F.col("id").alias("kb_id"), F.col("source_url").alias("url"), F.coalesce("title", F.lit("")).alias("title"), "content").dropDuplicates(["kb_id"])


_TREE = "array<struct<label: string, parts: array<string>>>"
_NODES = "array<struct<kind: string, key: string, place: double, after: double, most: int, every: boolean>>"


def _tree(rows) -> list[Tree]:  # noqa: ANN001
    return [(x["label"], tuple((p, ()) for p in x["parts"])) for x in rows] if rows is not None else []


@functools.lru_cache(50_000)
def _number(label: str) -> int:
    """A label as 64 bits; two labels with one number could only add a node to a tree."""
    return int.from_bytes(hashlib.blake2b(label.encode(), digest_size=8).digest(), "big", signed=True)


def _count_labels(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        n = Counter((s, x) for s, c, t, w in zip(f["site"], f["content"], f["title"], f["word"]) for x in {_number(y) for y in labels_of(Page(c, t, w).nodes)})
        yield pd.DataFrame([(*k, v) for k, v in n.items()], columns=["site", "label", "n"])


def frequent_labels(pages: DataFrame) -> DataFrame:
    """(site, labels) of every host and language: the labels on so many of all pages that their nodes may become constant.

    A node is never matched on more pages than its label is on, so no other node passes the shares of induce(), and these bound the list
    as they bound a template.
    """
    found = pages.select("site", "content", "title", "word").mapInPandas(_count_labels, "site string, label bigint, n bigint")
    host = write_and_read(found.groupBy("site", "label").agg(F.sum("n").alias("n")).withColumn("lang", F.substring_index("site", " ", -1)), "labels")
    sizes = pages.groupBy("site", "lang").agg(F.count("*").alias("pages"))
    all_pages = F.broadcast(sizes.groupBy("lang").agg(F.sum("pages").alias("pages")))
    common = host.groupBy("lang", "label").agg(F.sum("n").alias("n")).join(all_pages, "lang").where(F.col("n") >= F.greatest(F.lit(2), SHARE * F.col("pages")))
    by_lang = common.groupBy("lang").agg(F.collect_list("label").alias("common"))
    own = host.drop("lang").join(sizes, "site").where(F.col("n") >= F.greatest(F.lit(2), min(OWN_SHARE, KEEPS_SHARE) * F.col("pages")))
    by_host = own.groupBy("site").agg(F.collect_list("label").alias("own"))
    none = F.array().cast("array<bigint>")
    out = sizes.join(by_host, "site", "left").join(F.broadcast(by_lang), "lang", "left")
    return out.select("site", F.array_union(F.coalesce("own", none), F.coalesce("common", none)).alias("labels"))


def _rows_of(tree: Sequence[Tree]) -> list[dict]:
    return [{"label": label, "parts": [c[0] for c in children]} for label, children in tree]


def _grown(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The tree of each site and part, from rows of _side_by_side() with the labels to keep."""
    site, part, tree, labels, known = None, 0, [], set(), set()
    done = lambda: pd.DataFrame({"site": [site], "part": [part], "tree": pd.Series([_rows_of(tree)], dtype=object)})
    for f in frames:
        for row in f.to_dict("records"):
            if row["page"] == 0:
                if site is not None:
                    yield done()
                site, part, tree, labels, known = row["site"], row["part"], [], set(row["labels"]), set()
            elif row["site"] == site:
                page = reduced(Page(row["content"], row["title"], row["word"]).nodes, lambda x: _number(x) in labels)
                if page not in known:  # else all of it would match
                    if len(known) == KNOWN:
                        known.clear()
                    known.add(page)
                    tree = grow(tree, page)
    if site is not None:
        yield done()


def _merged(f: pd.DataFrame) -> pd.DataFrame:
    tree: list[Tree] = []
    for x in f.sort_values("part")["tree"]:
        tree = grow(tree, _tree(x))
    return pd.DataFrame({"site": [f["site"].iat[0]], "tree": pd.Series([_rows_of(tree)], dtype=object)})


def host_trees(pages: DataFrame) -> DataFrame:
    """(site, tree) of every host and language, grown from all of its pages; the trees of the parts of a large one are aligned in turn."""
    parts = _side_by_side(pages, write_and_read(frequent_labels(pages), "frequent")).mapInPandas(_grown, f"site string, part int, tree {_TREE}")
    return parts.groupBy("site").applyInPandas(_merged, f"site string, tree {_TREE}")


def _side_by_side(pages: DataFrame, states: DataFrame) -> DataFrame:
    """PAGES and STATES (site, ...) by site, the row of a site (page = 0) before its pages, these by kb_id. Sites with very many pages are
    divided into parts, each with the row of its site.
    """
    hot = F.broadcast(hot_keys(pages, "site", HOT_PAGES))
    salted = lambda df: df.join(hot, df["site"] == hot["_hot"], "left")
    part = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64("kb_id"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    parts = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    a = salted(pages).select("site", part.alias("part"), F.lit(1).alias("page"), "kb_id", "content", "title", "word")
    b = salted(states).select(*states.columns, F.explode(parts).alias("part"), F.lit(0).alias("page"))
    return a.unionByName(b, allowMissingColumns=True).repartition("site", "part").sortWithinPartitions("site", "part", "page", "kb_id")


def _beside(pages: DataFrame, trees: DataFrame, run: Callable[[Page, object], list[tuple]], prepare: Callable[[pd.Series], object], schema: str) -> DataFrame:
    """RUN(page, state) of every page, as rows of (site, kb_id, *schema); the state is PREPARE(row of TREES of the page's site).

    The row of a site is sent and prepared once in each partition, not once per page.
    """
    names = ["site", "kb_id", *[x.split()[0] for x in schema.split(", ")]]

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        site, state = None, None
        for f in frames:
            out = []
            for row in f.to_dict("records"):
                if row["page"] == 0:
                    site, state = row["site"], prepare(row)
                elif row["site"] == site:
                    out += [(site, row["kb_id"], *x) for x in run(Page(row["content"], row["title"], row["word"]), state)]
            yield pd.DataFrame(out, columns=names)

    return _side_by_side(pages, trees).mapInPandas(each, f"site string, kb_id bigint, {schema}")


def induce(pages: DataFrame, trees: DataFrame) -> DataFrame:
    """The template of each host and language: (site, tree, nodes).

    The shares bound a template: it has at most (nodes of an average page) / SHARE nodes of the language and
    (nodes of an average page of the host) / KEEPS_SHARE of the host.
    """
    found = _beside(pages, trees, lambda page, tree: page.matched(tree), lambda row: _tree(row["tree"]), "kind string, key string, place double, titles int")
    lang = F.substring_index("site", " ", -1)
    after = (F.col("titles") > 0).cast("int")
    host = found.groupBy("site", "kind", "key").agg(F.count("*").alias("n"), F.sum("place").alias("place"), F.sum(after).alias("after"), F.percentile_approx("titles", TITLES_SHARE).alias("most"))
    host = write_and_read(host.withColumn("lang", lang), "nodes")
    sizes = pages.groupBy("site", "lang").agg(F.count("*").alias("pages"))
    every = host.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"), F.sum("place").alias("place"), F.sum("after").alias("after"), F.max("most").alias("most"))
    all_pages = F.broadcast(sizes.groupBy("lang").agg(F.sum("pages").alias("pages")))
    common = every.join(all_pages, "lang").where(F.col("n") >= F.greatest(F.lit(2), SHARE * F.col("pages")))
    mean = lambda c: F.col(c) / F.col("n")
    common = common.select("lang", "kind", "key", mean("place").alias("place"), mean("after").alias("after"), "most", F.lit(True).alias("every"))
    node = F.struct("kind", "key", "place", "after", "most", "every")
    by_lang = common.groupBy("lang").agg(F.collect_list(node).alias("common"))
    found = host.join(sizes.drop("lang"), "site")
    keeps = found.groupBy("lang", "kind", "key").agg(
        F.sum("n").alias("all"), (F.sum("after") / F.sum("n")).alias("titled"), F.max("most").alias("most_titles"),
        F.sum(F.col("n") * (F.col("n") - 1)).alias("met"), F.sum(F.col("n") * (F.col("pages") - 1)).alias("could"),
    )
    keeps = keeps.where((F.col("all") >= KEEPS_LEAST) & (F.col("met") >= KEEPS * F.col("could")) & (F.col("could") > 0)).select("lang", "kind", "key", "titled", "most_titles", F.lit(True).alias("keeps"))
    own = found.join(keeps, ["lang", "kind", "key"], "left").withColumn("keeps", F.coalesce("keeps", F.lit(False)))
    alone = (F.col("pages") >= OWN_PAGES) & (F.col("n") >= OWN_SHARE * F.col("pages"))
    own = own.where(alone | (F.col("keeps") & (F.col("n") >= KEEPS_SHARE * F.col("pages"))))
    own = own.select("site", "kind", "key", mean("place").alias("place"), F.coalesce("titled", mean("after")).alias("after"), F.coalesce("most_titles", "most").alias("most"), F.col("keeps").alias("every"))
    by_host = own.groupBy("site").agg(F.collect_list(node).alias("own"))
    none = F.array().cast(_NODES)
    out = trees.withColumn("lang", lang).join(by_host, "site", "left").join(F.broadcast(by_lang), "lang", "left")
    return out.select("site", "tree", F.concat(F.coalesce("own", none), F.coalesce("common", none)).alias("nodes"))  # of a node in both the common one counts


def furniture(pages: DataFrame) -> DataFrame:
    """(kb_id, line_no) of the lines with visible text that are not the page's body, for PAGES (kb_id, url, title, content).

    A page with a null or empty content has no lines. A URL without a host makes a host of its own, the empty one.
    """
    pages = site_columns(pages.where("content is not null"))
    trees = write_and_read(host_trees(pages), "trees")

    def prepare(row: dict) -> Template:
        nodes = [(x["kind"], x["key"], x["place"], x["after"], x["most"], x["every"]) for x in row["nodes"]]
        return Template(_tree(row["tree"]), nodes)

    found = _beside(pages, write_and_read(induce(pages, trees), "templates"), lambda page, template: [(n,) for n in template_lines(page, template)], prepare, "line_no int")
    return found.select("kb_id", "line_no")


def main_text(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """(kb_id, body) of every page: its content without the LINES (kb_id, line_no) that furniture() gave; null if nothing is left."""
    drop = lines.groupBy("kb_id").agg(F.collect_set("line_no").alias("drop"))
    kept = F.expr("filter(split(content, '\\n', -1), (x, i) -> not array_contains(coalesce(drop, array()), i + 1))")
    body = F.trim(F.array_join(kept, "\n"))
    return pages.join(drop, "kb_id", "left").select("kb_id", F.when(body != "", body).alias("body"))


def _readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The web pages, garbled titles and contents restored where possible (line breaks stay where they are)."""
    pages = pages_of(table(spark, sf_dir, "knowledge_base"))
    texts = text_fields(spark, sf_dir, ("knowledge_base",))
    fixed = label(texts, fit(texts)).groupBy(F.col("rec_id").alias("kb_id")).pivot("field", ["title", "content"]).agg(F.first("restored"))
    fixed = fixed.select("kb_id", F.col("title").alias("t"), F.col("content").alias("c"))
    same = F.size(F.split("c", "\n", -1)) == F.size(F.split("content", "\n", -1))
    joined = pages.join(fixed, "kb_id", "left")
    return joined.select("kb_id", "url", F.coalesce("t", "title").alias("title"), F.when(same, F.col("c")).otherwise(F.col("content")).alias("content"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return furniture(write_and_read(_readable(spark, sf_dir), "pages"))


def p5_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = write_and_read(_readable(spark, sf_dir), "pages")
    return main_text(pages, furniture(pages))


QUERIES = {"p5_found": p5_found, "p5_bodies": p5_bodies}
ORACLE: dict[str, str] = {}
