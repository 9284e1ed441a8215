"""Heading trees of Markdown and plain text, and what is made of them: thinning, chunks, breadcrumbs, outlines.

A tree is stored as rows (doc, node, parent, ordinal, level, title, content, breadcrumbs): Spark has no recursive types.
Node ids are ``{doc}-{ordinal}``, so they are unique across documents, and ordinals are integers, so 10 comes after 2.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from folioframe.functions import text as T

NODE = "file_path string, id string, parent_id string, ordinal int, level int, title string, content string, page int, breadcrumbs array<string>, tokens int"
_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_RULE = re.compile(r"^ {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")


def headings(text: str) -> Iterator[tuple[int, int, str]]:
    """(line, level, title) of each heading outside of code fences; also titles underlined with = or -."""
    fence, lines = "", text.split("\n")
    for i, line in enumerate(lines):
        mark = _FENCE.match(line)
        if mark:
            if not fence:
                fence = mark[1]
            elif mark[1].startswith(fence[0] * len(fence)):
                fence = ""
            continue
        if fence:
            continue
        hit = _HEADING.match(line)
        if hit:
            yield i, len(hit[1]), plain_title(hit[2] or "")
        elif _SETEXT.match(line) and i and lines[i - 1].strip() and not _HEADING.match(lines[i - 1]) and not _RULE.match(line) and not lines[i - 1].lstrip().startswith(("|", "- ", "> ")):
            yield i - 1, 1 if "=" in line else 2, plain_title(lines[i - 1])


def plain_title(title: str) -> str:
    """A heading without emphasis, code marks and link targets."""
    title = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", title)
    return re.sub(r"(\*\*|__|[*_`~])(\S.*?)\1", r"\2", title).strip()


def split_pages(pages: list[tuple[int, str]]) -> list[dict]:
    """Nodes of one document from its pages in order: a section stays open over page breaks; the first page of a node is
    kept. The heading is the first line of the node's content. Text before the first heading belongs to the root."""
    nodes = [{"level": 0, "title": "", "parent": None, "content": [], "page": pages[0][0] if pages else None}]
    stack = [0]
    for number, text in pages:
        lines = text.split("\n")
        starts = {i: (level, title) for i, level, title in headings(text)}
        for i, line in enumerate(lines):
            if i in starts:
                level, title = starts[i]
                while nodes[stack[-1]]["level"] >= level:
                    stack.pop()
                nodes.append({"level": level, "title": title, "parent": stack[-1], "content": [], "page": number})
                stack.append(len(nodes) - 1)
            if _RULE.match(line) and i not in starts and i - 1 not in starts:
                continue
            nodes[stack[-1]]["content"].append(line)
    for n in nodes:
        n["content"] = re.sub(r"\n{3,}", "\n\n", "\n".join(n["content"])).strip()
    return nodes


def count_tokens(text: str) -> int:
    return len(text.split())


def thin(nodes: list[dict], threshold: int) -> list[dict]:
    """Small nodes take in their children, from the leaves up; the root is left as it is. A node below ``threshold`` tokens
    absorbs its children if it has one child, or if all its children are leaves below the threshold too."""
    if threshold <= 0:
        return nodes
    children: dict[int, list[int]] = {}
    for i, n in enumerate(nodes):
        if n["parent"] is not None:
            children.setdefault(n["parent"], []).append(i)
    gone: set[int] = set()
    for i in range(len(nodes) - 1, 0, -1):  # parents come before their children
        kids = children.get(i, [])
        small = lambda j: count_tokens(nodes[j]["content"]) < threshold
        if not kids or not small(i):
            continue
        if len(kids) == 1 or all(small(j) and not children.get(j) for j in kids):
            nodes[i]["content"] = "\n\n".join(x for x in (nodes[i]["content"], *(nodes[j]["content"] for j in kids)) if x)
            children[i] = [g for j in kids for g in children.get(j, [])]
            for g in children[i]:
                nodes[g]["parent"] = i
            gone |= set(kids)
    number = {}
    kept = []
    for i, n in enumerate(nodes):
        if i not in gone:
            number[i] = len(kept)
            kept.append(n)
    for n in kept:
        n["parent"] = None if n["parent"] is None else number[n["parent"]]
    return kept


def _rows(path: str, title: str, nodes: list[dict]) -> list[tuple]:
    nodes[0]["title"] = title
    trail: list[list[str]] = []
    out = []
    for i, n in enumerate(nodes):
        up = [] if n["parent"] is None else [*trail[n["parent"]], nodes[n["parent"]]["title"]]
        trail.append(up)
        parent = None if n["parent"] is None else f"{path}-{n['parent']}"
        out.append((path, f"{path}-{i}", parent, i, n["level"], n["title"], n["content"], n["page"], up, count_tokens(n["content"])))
    return out


_COLUMNS = [c.split()[0] for c in NODE.split(", ")]


def markdown_tree(docs: DataFrame, *, path: str = "file_path", text: str = "text", threshold: int = 0) -> DataFrame:
    """The heading trees of documents, one row per node; row by row, so no shuffle. Null texts give the root alone; null paths
    are left out."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for p, t in zip(part["p"], part["t"]):
                rows += _rows(p, p.replace("\\", "/").rsplit("/", 1)[-1], thin(split_pages([(None, t or "")]), threshold))
            yield pd.DataFrame(rows, columns=_COLUMNS).astype({"page": "Int32", "ordinal": "int32", "level": "int32", "tokens": "int32"})

    rows = docs.select(F.col(path).alias("p"), F.col(text).alias("t")).where("p is not null")
    return rows.mapInPandas(run, NODE)


def page_tree(pages: DataFrame, *, threshold: int = 0) -> DataFrame:
    """One tree per document from its pages (file_path, page, content); the pages of a document are gathered, which its size
    bounds."""

    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        ordered = part.sort_values(["page"], kind="stable")
        nodes = thin(split_pages([(int(n), t or "") for n, t in zip(ordered["page"], ordered["content"])]), threshold)
        rows = _rows(key[0], key[0].replace("\\", "/").rsplit("/", 1)[-1], nodes)
        return pd.DataFrame(rows, columns=_COLUMNS).astype({"page": "Int32", "ordinal": "int32", "level": "int32", "tokens": "int32"})

    return pages.where("file_path is not null").groupBy("file_path").applyInPandas(run, NODE)


def enriched_text(node: str = "content") -> Column:
    """What is embedded of a node: file, path tags, section trail, and the content."""
    head = F.concat(F.lit("File: "), T.file_name(F.col("file_path")), F.lit(" | Path: "), T.path_tags(F.col("file_path")))
    trail = F.array_join(F.filter(F.array_append("breadcrumbs", F.col("title")), lambda t: t != ""), " > ")
    return F.concat_ws("\n", head, F.concat(F.lit("Section: "), trail), F.col(node))


def chunks_of_trees(nodes: DataFrame, doc_type: str = "text", embed=None) -> DataFrame:
    """Chunk rows of the nodes that have content: id, text, vector, file_path, parent_id, breadcrumbs, doc_type.

    ``embed`` is a function from a text Column to a vector Column; without it the vector is null.
    """
    vector = embed(enriched_text()) if embed else F.lit(None).cast("array<float>")
    return nodes.where("content != ''").select("id", F.col("content").alias("text"), vector.alias("vector"), "file_path", "parent_id", F.array_join("breadcrumbs", " > ").alias("breadcrumbs"), F.lit(doc_type).alias("doc_type"))


def outlines(nodes: DataFrame, root_chars: int = 200, line_chars: int = 100) -> DataFrame:
    """One summary row per document: its title, the first characters of the root, and every heading indented by depth with the
    first line below it: id ``{path}-doc-summary``, text, file_path."""
    below = F.filter(F.slice(F.split("content", "\n"), 2, 10_000), lambda x: F.trim(x) != "")  # without the heading
    first = F.get(below, 0)
    depth = F.size("breadcrumbs")
    line = F.when(
        F.col("parent_id").isNull(), F.concat_ws("\n", F.concat(F.lit("# "), F.col("title")), F.nullif(F.left("content", F.lit(root_chars)), F.lit("")))
    ).otherwise(F.concat(F.repeat(F.lit("  "), depth - 1), F.lit("- "), F.col("title"), F.coalesce(F.concat(F.lit(": "), F.left(F.trim(first), F.lit(line_chars))), F.lit(""))))
    lines = nodes.select("file_path", F.struct("ordinal", line.alias("l")).alias("x")).groupBy("file_path").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return lines.select(F.concat("file_path", F.lit("-doc-summary")).alias("id"), F.array_join(F.transform("xs", lambda x: x["l"]), "\n").alias("text"), "file_path")


def summarize(nodes: DataFrame, provider, least_tokens: int) -> DataFrame:
    """``summary`` from a provider (Column to Column) for nodes of more than ``least_tokens`` tokens, null for others."""
    return nodes.withColumn("summary", F.when(F.col("tokens") > least_tokens, provider(F.col("content"))))
