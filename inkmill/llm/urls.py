"""URL filter: a trie over reversed host labels, then over the path.

``judge_urls`` decides each URL by the longest matching rule. Rules are pairs
(host, path) with an action; a rule fits its host and every subdomain, if the
URL's path starts with the rule's path. Hosts are compared label by label from
the right, so the deepest host node with a fitting path wins and, at one node,
the longest path does.

The path part of the trie has one edge per complete segment; a last piece that
need not end at a slash (``/en/1`` fits ``/en/12``) is kept as a prefix entry
of the node, looked up by length.

Defined results: a null URL, or one without ``://``, has an empty host and an
empty path, no rule and the default verdict. ``org/`` needs a path that starts
with ``/``, so ``http://a.org`` (empty path) fits no rule. Repeated rows are
judged row by row; other columns of the input are dropped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.llm.common import load

#: Rules that may take more nodes or characters than this aren't made a trie (about 0.5 kB a node in each worker).
MAX_NODES = 200_000
MAX_RULE_CHARS = 16 * 1024 * 1024

Rule = tuple[str, str, str]  # host, path, "allow" | "block"

#: Fixed values of the registered query.
QUERY_RULES: tuple[Rule, ...] = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


class _PathNode:
    __slots__ = ("children", "lengths", "prefixes")

    def __init__(self) -> None:
        self.children: dict[str, _PathNode] = {}
        self.prefixes: dict[str, tuple[str, str]] = {}
        self.lengths: list[int] = []

    def add(self, path: str, entry: tuple[str, str]) -> None:
        node = self
        *segments, last = path.split("/")
        for segment in segments:
            node = node.children.setdefault(segment, _PathNode())
        # of two equal rules a block stands, whatever the order of the list
        if node.prefixes.get(last, ("", "allow"))[1] != "block":
            node.prefixes[last] = entry
        if len(last) not in node.lengths:
            node.lengths = sorted([*node.lengths, len(last)], reverse=True)

    def find(self, path: str) -> tuple[str, str] | None:
        best, node, rest = None, self, path
        while node is not None:
            segment, slash, after = rest.partition("/")
            for n in node.lengths:
                if n <= len(segment) and (hit := node.prefixes.get(segment[:n])):
                    best = hit
                    break
            if not slash:
                break
            node, rest = node.children.get(segment), after
        return best


class _HostNode:
    __slots__ = ("children", "paths")

    def __init__(self) -> None:
        self.children: dict[str, _HostNode] = {}
        self.paths: _PathNode | None = None


class UrlTrie:
    """Reversed host labels first, path segments below them."""

    def __init__(self, rules: Iterable[Rule]) -> None:
        self.root = _HostNode()
        for host, path, action in rules:
            node = self.root
            for label in reversed(host.lower().split(".")):
                node = node.children.setdefault(label, _HostNode())
            if node.paths is None:
                node.paths = _PathNode()
            node.paths.add(path, (host.lower() + path, action))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best, node = None, self.root
        for label in reversed(host.split(".")):
            node = node.children.get(label)
            if node is None:
                break
            if node.paths is not None and (hit := node.paths.find(path)):
                best = hit
        return best


def split_url_sql(url: str) -> tuple[str, str]:
    """SQL for host and path of a URL column (RE2-safe, valid in both dialects)."""
    rest = f"substr({url}, instr({url}, '://') + 3)"
    ok = f"coalesce(instr({url}, '://'), 0) > 0"
    host = f"case when {ok} then translate(regexp_replace({rest}, '(?s)[/?#].*$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end"
    after = f"substr({rest}, length(regexp_replace({rest}, '(?s)[/?#].*$', '')) + 1)"
    path = f"case when {ok} then regexp_replace({after}, '(?s)[?#].*$', '') else '' end"
    return host, path


def judge_urls(
    pages: DataFrame,
    rules: Iterable[Rule] = QUERY_RULES,
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Host, path, deciding rule and verdict of each row of ``pages``.

    The trie is broadcast if it is sure to have at most ``MAX_NODES`` nodes;
    larger rule sets are a table, joined by host and its parent domains.
    """
    rules = list(rules)
    if sum(h.count(".") + p.count("/") + 2 for h, p, _ in rules) > MAX_NODES or sum(len(h) + len(p) for h, p, _ in rules) > MAX_RULE_CHARS:
        return judge_by_join(pages, pages.sparkSession.createDataFrame(rules, "host string, path string, action string"), default, id_col, url_col)
    shared = pages.sparkSession.sparkContext.broadcast(rules)

    @F.pandas_udf("rule string, verdict string")
    def decide(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = UrlTrie(shared.value)
        for hosts, paths in batches:
            hits = [trie.find(h, p) for h, p in zip(hosts, paths)]
            yield pd.DataFrame({"rule": [h[0] if h else None for h in hits], "verdict": [h[1] if h else default for h in hits]})

    host, path = split_url_sql(f"`{url_col}`")
    parts = pages.select(F.col(id_col), F.expr(host).alias("host"), F.expr(path).alias("path"))
    return parts.withColumn("d", decide("host", "path")).select(id_col, "host", "path", F.col("d.rule").alias("rule"), F.col("d.verdict").alias("verdict"))


def judge_by_join(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``judge_urls`` for a table of rules (host, path, action) of any size.

    Distinct (host, path) pairs meet the rules of their host and parent domains
    by an equi-join; the longest host, then the longest path decides.
    """
    host, path = split_url_sql(f"`{url_col}`")
    parts = pages.select(F.col(id_col), F.expr(host).alias("host"), F.expr(path).alias("path"))
    suffixes = "explode(transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), -i, i), '.'))) as rhost"
    asked = parts.select("host", "path").distinct().selectExpr("host as a_host", "path as a_path", suffixes)
    known = rules.selectExpr("lower(host) as rhost", "path as rpath", "action").groupBy("rhost", "rpath").agg(F.max("action").alias("action"))
    # the paths of a rule by length: a rule's path is a prefix of the URL's, so it is looked up by equality
    lengths = known.selectExpr("rhost", "length(rpath) as n").distinct()
    probes = asked.join(lengths, "rhost").filter("n <= length(a_path)").selectExpr("a_host", "a_path", "rhost", "left(a_path, n) as rpath")
    hits = probes.join(known, ["rhost", "rpath"]).groupBy("a_host", "a_path").agg(F.max_by(F.struct(F.concat("rhost", "rpath").alias("rule"), "action"), F.struct(F.length("rhost"), F.length("rpath"))).alias("hit"))
    same = (F.col("host") == F.col("a_host")) & (F.col("path") == F.col("a_path"))
    return parts.join(hits, same, "left").select(id_col, "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.action", F.lit(default)).alias("verdict"))


def op10_url_filters(spark, sf_dir):
    return judge_urls(load(spark, sf_dir, "pages"))


_HOST, _PATH = split_url_sql("url")
OP10_SQL = f"""
with parts as (select page_id, {_HOST} as host, {_PATH} as path from pages),
rules(rhost, rpath, action) as (values {", ".join(f"('{h}','{p}','{a}')" for h, p, a in QUERY_RULES)}),
hits as (
  select page_id, max_by(rhost || rpath, length(rhost) * 100000 + length(rpath)) as rule,
         max_by(action, length(rhost) * 100000 + length(rpath)) as verdict
  from parts join rules on (host = rhost or host like '%.' || rhost) and starts_with(path, rpath)
  group by page_id)
select p.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict
from parts p left join hits h on p.page_id = h.page_id
"""
