"""URL filter by path templates.

Per host the paths form a tree of segments (the query string counts as one more
segment of its parameter names).  Segments that look variable (digits, hex,
dates, long mixed strings) become wildcards, and so do siblings that are many
and rare, but for those whose labels differ from the wildcard's beyond chance.  Branches of one parent merge when the paths below them are distributed
alike (Jensen-Shannon divergence up to ``DIVERGENCE``) and their shares of bad
labels don't differ beyond chance (two proportions, ``Z``).  A template's purity is
the share of bad labels among its pages, smoothed towards the whole share; a
template with enough labels and purity of at least ``PURITY`` is rejected.

Paths are counted per host and distinct path before a host's tree is built in one
task, so the task's size follows the distinct paths after wildcards, not pages.

Defined cases: a null or empty URL has the empty host and the template ``/``; a
scheme, user, port, ``www.``, ``m.`` and the fragment don't count; a null label is
none; several labels of one page are averaged; without labels nothing is
rejected; repeated rows count and are returned each; URLs of any length are split
whole; among up to ``MOST`` siblings none is rare, from one more on those below
``RARE`` of their parent are; an empty table gives no rows; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tools
from .tools import cut

#: A parent with more distinct children than this turns those below RARE of it, and with like labels, into a wildcard.
MOST, RARE = 32, 0.02
DIVERGENCE, Z = 0.1, 1.96
SMOOTHING = 10.0
LEAST_LABELS = 5
PURITY = 0.5

VARIABLE = r"^(?:\d+|[0-9a-f]{8,}|[0-9a-f]{8}-[0-9a-f-]{27}|\d{4}-\d{2}(?:-\d{2})?|(?=.*\d)(?=.*[A-Za-z])[A-Za-z0-9_-]{12,})(\.[A-Za-z]{1,5})?$"


def split(url):
    """Host and path of a URL, with variable segments made wildcards, in the JVM."""
    text = F.coalesce(url, F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^(?:[^/?@]*@)?([^/?:]*)", 1))
    host = F.regexp_replace(host, r"^(?:www|m)\.", "")
    rest = F.regexp_replace(bare, r"^[^/?]*", "")
    path = F.regexp_extract(rest, r"^([^?]*)", 1)
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    segments = F.transform(segments, lambda s: F.when(s.rlike(VARIABLE), F.concat(F.lit("*"), F.regexp_extract(s, VARIABLE, 1))).otherwise(s))
    names = F.array_sort(F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.regexp_extract(p, r"^([^=]*)", 1)))
    segments = F.when(F.size(names) > 0, F.concat(segments, F.array(F.concat(F.lit("?"), F.array_join(names, "&"))))).otherwise(segments)
    return host, F.concat(F.lit("/"), F.array_join(segments, "/"))


class Node:
    __slots__ = ("count", "ends", "labels", "bad", "children", "paths")

    def __init__(self):
        self.count = self.ends = self.labels = 0
        self.bad = 0.0
        self.children, self.paths = {}, []

    def shape(self) -> dict[str, int]:
        """Pages by the rest of their path below this node."""
        out: dict[str, int] = {}
        todo = [(self, "")]
        while todo:
            node, rest = todo.pop()
            if node.ends:
                out[rest] = out.get(rest, 0) + node.ends
            todo += [(child, f"{rest}/{name}") for name, child in node.children.items()]
        return out


def unlike_labels(a: Node, b: Node) -> bool:
    """Whether the shares of bad labels differ beyond chance (two proportions)."""
    if not a.labels or not b.labels:
        return False
    p = (a.bad + b.bad) / (a.labels + b.labels)
    spread = (p * (1 - p) * (1 / a.labels + 1 / b.labels)) ** 0.5
    return abs(a.bad / a.labels - b.bad / b.labels) > Z * spread if spread else False


def divergence(a: dict[str, int], b: dict[str, int]) -> float:
    """Jensen-Shannon divergence of two distributions, in bits."""
    x, y = sum(a.values()), sum(b.values())
    if not x or not y:
        return 0.0 if x == y else 1.0
    out = 0.0
    for key in a.keys() | b.keys():
        p, q = a.get(key, 0) / x, b.get(key, 0) / y
        m = (p + q) / 2
        out += (p * math.log2(p / m) if p else 0) / 2 + (q * math.log2(q / m) if q else 0) / 2
    return out


def generalise(paths: list[str], counts: list[int], labels: list[int] | None = None, bad: list[float] | None = None) -> dict[str, str]:
    """The template of each path of one host."""
    root = Node()
    none = [0] * len(paths)
    for path, count, labelled, wrong in sorted(zip(paths, counts, labels or none, bad or none, strict=True)):
        node = root
        for segment in ["", *(path.split("/")[1:] if path != "/" else [])]:
            node = node.children.setdefault(segment, Node()) if segment else node
            node.count += count
            node.labels += labelled
            node.bad += wrong
        node.ends += count
        node.paths.append(path)

    def absorb(into: Node, other: Node) -> None:
        todo = [(into, other)]
        while todo:
            a, b = todo.pop()
            a.count, a.ends, a.labels, a.bad = a.count + b.count, a.ends + b.ends, a.labels + b.labels, a.bad + b.bad
            a.paths += b.paths
            for name, child in b.children.items():
                if name in a.children:
                    todo.append((a.children[name], child))
                else:
                    a.children[name] = child

    # depth first, without recursion: long paths are deep trees
    out: dict[str, str] = {}
    todo = [(root, "")]
    while todo:
        node, prefix = todo.pop()
        for path in node.paths:
            out[path] = prefix or "/"
        children = node.children
        if len(children) > MOST:
            rare = [(n, c) for n, c in sorted(children.items()) if c.count < RARE * node.count and not n.startswith(("*", "?"))]
            # too few labels tell nothing; the others follow by how near they are to the middle
            # branch, so that no odd one sets the wildcard's share
            told = [(n, c) for n, c in rare if c.labels >= LEAST_LABELS]
            middle = float(np.median([c.bad / c.labels for _, c in told])) if told else 0.0
            told.sort(key=lambda x: abs(x[1].bad / x[1].labels - middle))
            for name, child in [(n, c) for n, c in rare if c.labels < LEAST_LABELS] + told:
                if "*" not in children:
                    children["*"] = children.pop(name)
                elif child.labels < LEAST_LABELS or not unlike_labels(children["*"], child):
                    absorb(children["*"], children.pop(name))
        # branches that go on alike below, with labels alike, become one
        merged: list[tuple[list[str], Node, dict[str, int]]] = []
        for name, child in sorted(children.items(), key=lambda x: (-x[1].count, x[0])):
            home, shape = None, {}
            if len(children) > 1 and child.children and not name.startswith("?"):
                shape = child.shape()
                home = next((m for m in merged if m[1].children and not unlike_labels(m[1], child) and divergence(m[2], shape) <= DIVERGENCE), None)
            if home:
                absorb(home[1], child)
                home[0].append(name)
                # what both have below them adds up, so no shape is taken twice
                for rest, n in shape.items():
                    home[2][rest] = home[2].get(rest, 0) + n
            else:
                merged.append(([name], child, shape))
        for names, child, _ in merged:
            todo.append((child, f"{prefix}/{'*' if '*' in names else '|'.join(sorted(names))}"))
    return out


def templates(pages: DataFrame, bad: DataFrame) -> DataFrame:
    """Columns page_id, host, template, labelled, purity, reject.

    ``bad`` has page_id and bad (0 or 1) of the labelled pages."""
    known = bad.where(F.col("bad").isNotNull() & F.col("page_id").isNotNull()).groupBy("page_id").agg(F.avg(F.col("bad").cast("double")).alias("bad"))
    host, path = split(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).join(known, "page_id", "left")
    rows = cut(rows)
    counted = cut(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("bad").alias("labels"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad")))
    prior = counted.agg((F.coalesce(F.sum("bad"), F.lit(0.0)) / F.greatest(F.sum("labels"), F.lit(1))).alias("p")).first()["p"] or 0.0

    def build(host_rows: pd.DataFrame) -> pd.DataFrame:
        names = generalise(host_rows["path"].tolist(), host_rows["n"].tolist(), host_rows["labels"].tolist(), host_rows["bad"].tolist())
        out = host_rows.assign(template=host_rows["path"].map(names))
        total = out.groupby("template")[["labels", "bad"]].transform("sum")
        out["labelled"] = total["labels"].astype("int64")
        out["purity"] = (total["bad"] + SMOOTHING * prior) / (total["labels"] + SMOOTHING)
        out["reject"] = (out["labelled"] >= LEAST_LABELS) & (out["purity"] >= PURITY)
        return out[["host", "path", "template", "labelled", "purity", "reject"]]

    found = counted.groupBy("host").applyInPandas(build, "host string, path string, template string, labelled long, purity double, reject boolean")
    found = cut(found)
    side = F.broadcast(found) if found.count() <= tools.BROADCAST_ROWS // 10 else found
    return rows.select("page_id", "host", "path").join(side, ["host", "path"]).select("page_id", "host", "template", "labelled", "purity", "reject")


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of pages by the document number in their URLs: bad is low quality."""
    number = F.regexp_extract("url", r"/(\d+)(?:[/.?#]|$)", 1).try_cast("long")
    return pages.select("page_id", number.alias("doc_id")).where(F.col("doc_id").isNotNull()).join(labels.select("doc_id", (1 - F.col("quality")).alias("bad")), "doc_id").select("page_id", "bad")
