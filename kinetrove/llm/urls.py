"""URL filtering by a path-template tree, in DataFrame functions only.

A url's host and path are cut out, explicit rules are applied (longest first), and
urls without a rule are judged by their template. Per host, path segments made of
digits become ``{n}``; then, from the root down to the deepest segment of any path, a node whose segment
is variable has its children replaced by ``*``. A segment is variable if more than the share ``NEW`` of the node's pages
show a child that no page before them had, at the 5 % level (Wilson's lower bound). A template is a host and such a path. Branches
of one registered domain with the same path are merged where their labelled rates
do not differ at the 5 % level (a branch without labels joins its siblings).

Labels are the verdicts of the rules. A template's purity is its share of good labels, smoothed by ``SMOOTH`` labels of
the purity of the same path in its registered domain, that by as many of the path's purity on all hosts, and that by as many of one half.
So a template without labels is judged by the same path elsewhere, and one whose path has none anywhere keeps
one half. Below one half it is rejected.

Pages are first summed up per host and digit-free path, with map-side partial
sums, so a hot host costs no more than others; the tree works on those sums.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import discard, stored

NEW, SMOOTH = 0.25, 2.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path) of the registered query (fixed values).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
MOST_RULES = 10_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match_rules(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    cases = None
    for verdict, rule_host, rule_path in longest:
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        cases = F.when(fits, value) if cases is None else cases.when(fits, value)
    return cases


def _loose(df: DataFrame, column: str) -> DataFrame:
    """``df`` with its partitioning by a text column forgotten, so that a join deals it out anew and Spark can split a hot key of the other side."""
    return df.withColumn(column, F.reverse(F.reverse(column)))


def _met(rows: DataFrame, nodes: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of their node; a host that holds most paths is split."""
    at = _loose(nodes, "host").select(F.col("host").alias("_host"), F.col("node").alias("_node"), *[c for c in nodes.columns if c not in ("host", "node")])
    return rows.join(at, (F.col("host") == F.col("_host")) & F.col("node").eqNullSafe(F.col("_node")), how).drop("_host", "_node")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, new: float = NEW, smooth: float = SMOOTH) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every row.

    A null url, or one without ``://``, has empty host and path, and then no rule;
    such urls share one template. Repeated rows each count and each come back. Very long urls are taken whole; an empty table gives no rows; other columns are
    not read, whatever their names. A registered domain is the last two labels of a host, so hosts below a public suffix of two labels share one.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    found = match_rules(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("found", found)
    general = F.regexp_replace("path", "[0-9]+", "{n}")
    rows = rows.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("said"), general.alias("general"))
    sums = rows.groupBy("host", "general").agg(
        F.count(F.when(F.col("said") == "allow", 1)).alias("good"),
        F.count(F.when(F.col("said") == "block", 1)).alias("bad"),
        F.count(F.lit(1)).alias("pages"),
    )
    # a round's rows are stored, or each would double the plan. A round first follows what all rows of a node share, however many segments, and then
    # decides on the segment where they part; rows whose path has ended are not read again, nor are rows alone at their node, since nothing below it can vary
    left = stored(sums.withColumn("rest", F.split("general", "/", -1)).withColumn("node", F.lit(None).cast("string")), "paths")
    held, ended = [left], [left.limit(0)]
    joined = lambda parts: F.when(F.size(parts) > 0, F.concat_ws("/", "node", F.array_join(parts, "/"))).otherwise(F.col("node"))
    while not left.isEmpty():
        same = F.array_position(F.zip_with("lo", "hi", lambda a, b: a.eqNullSafe(b)), F.lit(False)).cast("int")
        shared = left.groupBy("host", "node").agg(F.min("rest").alias("lo"), F.max("rest").alias("hi"))
        shared = shared.select("host", "node", F.when(same > 0, same - 1).otherwise(F.size("lo")).alias("common"))
        level = _met(left, shared).withColumns({"node": joined(F.slice("rest", F.lit(1), F.col("common"))), "rest": F.slice("rest", F.col("common") + 1, F.size("rest"))})
        level = level.withColumn("part", F.get("rest", F.lit(0)))
        child = level.where("size(rest) > 0").groupBy("host", "node", "part").agg(F.sum("pages").alias("pages"))
        nodes = child.groupBy("host", "node").agg(F.sum("pages").cast("double").alias("n"), (F.count(F.lit(1)) - 1).cast("double").alias("fresh"))
        share, n = F.col("fresh") / F.col("n"), F.col("n")
        least = (share + 1.92 / n - 1.96 * F.sqrt(share * (1 - share) / n + 0.96 / (n * n))) / (1 + 3.84 / n)
        level = _met(level.drop("common"), nodes.select("host", "node", (least > new).alias("wild")), "left")
        step = F.when(F.size("rest") > 0, F.array(F.when(F.col("wild"), "*").otherwise(F.col("part")))).otherwise(F.array().cast("array<string>"))
        level = stored(level.select("host", "general", "good", "bad", "pages", joined(step).alias("node"), F.slice("rest", F.lit(2), F.size("rest")).alias("rest")), "level")
        held.append(level)
        ended.append(level.where("size(rest) = 0"))
        left = level.where("size(rest) > 0")
    tree = stored(reduce(DataFrame.unionByName, [e.select("host", "general", "good", "bad", F.col("node").alias("template")) for e in ended]), "tree")
    discard(*held)
    domain = F.substring_index("host", ".", -2)
    own = tree.groupBy("host", "template").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    pool = own.groupBy(domain.alias("domain"), "template").agg(F.sum("g").alias("pg"), F.sum("b").alias("pb"))
    everywhere = pool.groupBy("template").agg(F.sum("pg").alias("ag"), F.sum("pb").alias("ab"))
    prior = _loose(_loose(pool, "template").join(_loose(everywhere, "template"), "template"), "domain")
    joined = own.withColumn("domain", domain).join(prior, ["domain", "template"])
    g, b, pg, pb, ag, ab = (F.col(c).cast("double") for c in ("g", "b", "pg", "pb", "ag", "ab"))
    gap = g * (pg + pb) - pg * (g + b)
    alike = gap * gap <= F.lit(3.84) * pg * pb * (g + b)
    purity = lambda good, bad, prior: (good + smooth * prior) / (good + bad + smooth)
    near = purity(pg, pb, purity(ag, ab, F.lit(0.5)))
    pure = joined.select("host", "template", F.when(alike, near).otherwise(purity(g, b, near)).alias("purity"))
    judged = tree.select("host", "general", "template").join(pure, ["host", "template"]).select("host", "general", "template", "purity")
    out = rows.join(judged, ["host", "general"])
    verdict = F.coalesce("said", F.when(F.round("purity", 9) < 0.5, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", F.round("purity", 9).alias("purity"))


ORACLE = """
with recursive cut as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), parts as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut
), ruled as (
  select *, regexp_replace(path, '[0-9]+', '{n}', 'g') as general, case
    when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end as rule from parts
), said as (
  select *, case when rule in ('www.example.com/en/', 'com/') then 'allow' when rule is not null then 'block' end as said from ruled
), sums as (
  select host, general, count(*) filter (where said = 'allow') as good, count(*) filter (where said = 'block') as bad, count(*) as pages,
    string_split(general, '/') as parts from said group by host, general
), level(host, general, good, bad, pages, parts, node, k) as (
  select *, '', 0 from sums
  union all
  select host, general, good, bad, pages, parts, node || case when k > 0 then '/' else '' end ||
    case when (share + 1.92 / n - 1.96 * sqrt(share * (1 - share) / n + 0.96 / (n * n))) / (1 + 3.84 / n) > 0.25 then '*' else parts[k + 1] end, k + 1 from (
    select *, fresh / n as share from (
      select *, (sum(pages) over node_w)::double as n, round(sum(1.0::double / rows_of_child) over node_w) - 1 as fresh from (
        select *, count(*) over (partition by host, node, parts[k + 1]) as rows_of_child from level where k < len(parts))
      window node_w as (partition by host, node)))
), tree as (
  select host, general, good, bad, node as template from level where k = len(parts)
), own as (
  select host, template, sum(good)::double as g, sum(bad)::double as b, array_to_string(string_split(host, '.')[-2:], '.') as domain from tree group by host, template
), pool as (
  select domain, template, sum(g) as pg, sum(b) as pb from own group by domain, template
), everywhere as (
  select template, sum(pg) as ag, sum(pb) as ab from pool group by template
), near as (
  select host, template, g, b, (pg + 2 * ((ag + 1) / (ag + ab + 2))) / (pg + pb + 2) as near,
    (g * (pg + pb) - pg * (g + b)) * (g * (pg + pb) - pg * (g + b)) <= 3.84::double * pg * pb * (g + b) as same
  from own join pool using (domain, template) join everywhere using (template)
), pure as (
  select host, template, case when same then near else (g + 2 * near) / (g + b + 2) end as purity from near
)
select page_id, host, path, rule, coalesce(said, case when round(purity, 9) < 0.5 then 'block' else 'allow' end) as verdict, template, round(purity, 9) as purity
from said join tree using (host, general) join pure using (host, template)
"""
