"""URL allow/block filtering with a broadcast trie over reversed host labels and path segments.

A rule is (host, path, verdict). It fits its host and all subdomains when the url's path starts with the rule's path.
The longest fitting rule wins: more host labels first, then the longer path; of equal rules block beats allow.
Edge cases: a null url or one without "://" has empty host and path and fits no rule, nor does an empty path; no rule gives the default
verdict. Repeated rows give repeated results, an empty table an empty one.

The rules are a parameter list. A trie holds at most PART of them, which bounds what is broadcast and what a worker
holds; a longer list makes several tries, which judge the pages one after the other, with a cut table between, and the
longest match of all counts. So a list of any length gets the same method.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.llm.store import cut, table

#: Most rules of one trie.
PART = 200_000
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


class Trie:
    """Host labels from the right, then path segments; a rule's last segment may be a partial one, kept at its parent."""

    def __init__(self, rules):
        self.root: dict = {}
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.lower().split(".")):
                node = node.setdefault(("h", label), {})
            *whole, last = path.lstrip("/").split("/") if path.lstrip("/") else [""]
            for segment in whole:
                node = node.setdefault(("p", segment), {})
            ends = node.setdefault("ends", {})
            if ends.get(last, ("", "allow"))[1] != "block":
                ends[last] = (f"{host}/{path.lstrip('/')}", verdict, len(host.split(".")), len(path.lstrip("/")))
        # longest partial segment first
        stack = [self.root]
        while stack:
            node = stack.pop()
            if "ends" in node:
                node["ends"] = sorted(node["ends"].items(), key=lambda e: -len(e[0]))
            stack += [child for key, child in node.items() if key != "ends"]

    def _path(self, node: dict, segments: list[str]):
        found, i = None, 0
        while True:
            left = segments[i] if i < len(segments) else None
            if left is not None:
                found = next((rule for part, rule in node.get("ends", ()) if left.startswith(part)), found)
            # a segment followed by "/" is whole, and only then can deeper nodes be entered
            if left is None or i + 1 >= len(segments) or ("p", left) not in node:
                return found
            node, i = node[("p", left)], i + 1

    def match(self, host: str, path: str):
        """The longest fitting rule as (text, verdict, host labels, characters of path), or None."""
        if not host or not path.startswith("/"):
            return None
        segments = path[1:].split("/")
        node, found = self.root, None
        for label in reversed(host.split(".")):
            if ("h", label) not in node:
                break
            node = node[("h", label)]
            found = self._path(node, segments) or found
        return found


def url_parts(url):
    """Host (A-Z lower-cased) and path of a url column; both empty without "://"."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


_HIT = "struct<labels:int,chars:int,verdict:string,rule:string>"


def _judge(spark: SparkSession, rules):
    """Function of host and path: the longest match in a trie of these rules, or null; asked once for each distinct pair of a batch."""
    trie = spark.sparkContext.broadcast(Trie(rules))

    @F.arrow_udf(_HIT)
    def judge(host: pa.Array, path: pa.Array) -> pa.Array:
        pairs = list(zip(host.to_pylist(), path.to_pylist()))
        found = {p: trie.value.match(*p) for p in set(pairs)}
        hits = [found[p] or (None,) * 4 for p in pairs]
        rule, verdict, labels, chars = (list(x) for x in zip(*hits)) if hits else ([], [], [], [])
        columns = [pa.array(labels, pa.int32()), pa.array(chars, pa.int32()), pa.array(verdict, pa.string()), pa.array(rule, pa.string())]
        return pa.StructArray.from_arrays(columns, ["labels", "chars", "verdict", "rule"], mask=pa.array([r is None for r in rule], pa.bool_()))

    return judge


def filter_urls(pages: DataFrame, rules=RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url", part: int = PART) -> DataFrame:
    """One row per page: id, host, path, rule (text of the longest fitting rule, else null), verdict."""
    host, path = url_parts(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    best: Column = F.lit(None).cast(_HIT)
    for at in range(0, len(rules), part):
        judge = _judge(parts.sparkSession, rules[at : at + part])
        if at:  # one trie at a time in a worker
            parts, best = cut(parts.withColumn("best", best), "url-judged"), F.col("best")
        parts = parts.withColumn("hit", judge("host", "path"))
        best = F.greatest(best, F.col("hit")) if at else F.col("hit")  # of equally long matches block beats allow
        if at:
            parts = parts.withColumn("best", best).drop("hit")
            best = F.col("best")
    return parts.select("page_id", "host", "path", best["rule"].alias("rule"), F.coalesce(best["verdict"], F.lit(default)).alias("verdict"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its host, path, rule and verdict."""
    return filter_urls(table(spark, sf_dir, "pages"))


SQL = r"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM r),
m AS (
  SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path,
    CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
         WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
         WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/'
         WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
         WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/' END AS rule
  FROM h)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/es/', 'example.org/en/1', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM m
"""
