"""URL filters: longest-match rules, and propagation of trust and distrust over host edges for what no rule fits.

DataFrame functions only. Rules fit a host and its subdomains where the path starts with the rule's; the longest wins.
Hosts with allowed pages are trusted seeds, hosts with blocked pages distrusted ones, each by the share of its pages. Trust
spreads along links by personalised PageRank, distrust against them, both over edges (source host, target host, links)
that are summed before they are shuffled and over rounds of a join and a partial sum, until no host's trust or distrust
changes by more than `tolerance` of itself. That is relative, so a walk still on its way to a host it has not reached
goes on, however far and however small its share; the sums shrink by the damping, so it comes to an end. The SQL stops after
8 rounds and reads no links without a scheme; it says the same where that changes no verdict. A host is blocked where its
distrust is over `threshold` times its trust. Mass that reaches a host without links ends there.

What is joined back to pages is a row for each host: broadcast up to BROADCAST hosts, a counted bound, else salted, so
that a hot host is spread.

Defined results: a null url or one without :// has empty host and path and fits no rule. Null html has no links. Links
//host/path are edges as those with a scheme are; other relative links stay within their host and are no edges. Hosts that
nothing reaches are allowed. Rows that repeat, or have a null id, are judged like any other. An empty table gives an empty table. Other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.line_dedup import LOWER, UPPER
from tessera.llm.scratch import Scratch

BROADCAST, SALTS = 20_000, 64
HOST, PATH = r"(?s)^.*?://([^/?#]*)", r"(?s)^.*?://[^/?#]*([^?#]*)"
SCHEME = "[a-z][a-z0-9+.-]*:"
LINK = r"""(?i)href\s*=\s*["']?[a-z][a-z0-9+.-]*://([^/?#"'>\s]+)"""
EDGE = LINK.replace(SCHEME, f"(?:{SCHEME})?")  # LINK is the SQL's


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path


# The rules of the contract.
RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def split_url(url: Column) -> tuple[Column, Column]:
    return lower_ascii(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit(""))), F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The action and text of the longest rule that fits, else null; of equally long ones that with the longer host."""
    out = F.lit(None).cast("struct<action:string,rule:string>")
    for r in sorted(rules, key=lambda r: (len(str(r)), len(r.host), str(r))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.action).alias("action"), F.lit(str(r)).alias("rule"))).otherwise(out)
    return out


def propagate(nodes: DataFrame, edges: DataFrame, scratch: Scratch, tolerance: float, damping: float) -> DataFrame:
    """nodes (host, t0, d0), edges (src, dst, n) -> (host, trust, distrust)."""
    if edges.isEmpty():  # what the rounds below come to
        return nodes.select("host", *(((1 - damping) * F.col(c)).alias(new) for c, new in (("t0", "trust"), ("d0", "distrust"))))
    ranks = nodes.select("host", "t0", "d0", F.col("t0").alias("trust"), F.col("d0").alias("distrust"))
    outs, ins = edges.groupBy("src").agg(F.sum("n").alias("w_out")), edges.groupBy("dst").agg(F.sum("n").alias("w_in"))
    shares = scratch.keep(edges.join(outs, "src").join(ins, "dst").select("src", "dst", (F.col("n") / F.col("w_out")).alias("fw"), (F.col("n") / F.col("w_in")).alias("bw")), "shares")
    last, moved = None, True
    while moved:
        before, zero = ranks, F.lit(0.0)
        ahead = ranks.join(shares, F.col("host") == F.col("src")).select(F.col("dst").alias("host"), (F.col("trust") * F.col("fw")).alias("t"), zero.alias("d"))
        back = ranks.join(shares, F.col("host") == F.col("dst")).select(F.col("src").alias("host"), zero.alias("t"), (F.col("distrust") * F.col("bw")).alias("d"))
        gained = ahead.unionByName(back).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        keep = lambda own, got: (1 - damping) * F.col(own) + damping * F.coalesce(F.col(got), F.lit(0.0))
        ranks = nodes.join(gained, "host", "left").select("host", "t0", "d0", keep("t0", "t").alias("trust"), keep("d0", "d").alias("distrust"))
        ranks = scratch.keep(ranks, "ranks")
        was = before.select("host", F.col("trust").alias("t"), F.col("distrust").alias("d"))
        change = lambda new, old: F.abs(F.col(new) - F.col(old)) > tolerance * F.greatest(new, old)
        moved = not ranks.join(was, "host").filter(change("trust", "t") | change("distrust", "d")).isEmpty()
        if last is not None:
            scratch.drop(last)
        last = ranks
    return ranks.select("host", "trust", "distrust")


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: tuple[Rule, ...] = RULES, tolerance: float = 1e-6, damping: float = 0.85, threshold: float = 1.0) -> DataFrame:
    """(id_col, host, path, rule, verdict, trust, distrust)."""
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = split_url(F.col(url_col))
    judged = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), F.col(html_col).alias("html"))
    judged = judged.withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules))
    links = judged.filter("host != ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(EDGE), F.lit(1))).alias("to"))
    edges = links.select("src", lower_ascii(F.col("to")).alias("dst")).filter("src != dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    edges = scratch.keep(edges, "edges")
    own = judged.filter("host != ''").groupBy("host").agg(F.count_if(F.col("fit.action") == "allow").alias("a"), F.count_if(F.col("fit.action") == "block").alias("b"))
    own = scratch.keep(own, "hosts")
    total = own.agg(F.sum(F.col("a") + F.col("b"))).first()[0] or 1
    ends = edges.select(F.col("src").alias("host")).union(edges.select("dst")).distinct()
    share = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.lit(float(total))
    nodes = scratch.keep(own.join(ends, "host", "full").select("host", share("a").alias("t0"), share("b").alias("d0")), "nodes")
    known = scratch.keep(propagate(nodes, edges, scratch, tolerance, damping).withColumnRenamed("host", "of"), "known")
    rows = judged.select("id", "host", "path", F.col("fit.action").alias("action"), F.col("fit.rule").alias("rule"))
    if known.count() <= BROADCAST:
        rows = rows.join(F.broadcast(known), F.col("host") == F.col("of"), "left")
    else:
        salted = known.withColumn("salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("id", "path"), F.lit(SALTS)).cast("int")).join(salted, (F.col("host") == F.col("of")) & (F.col("salt") == F.col("salt2")), "left")
    method = F.when(F.col("distrust") > threshold * F.col("trust"), "block").otherwise("allow")
    return rows.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("action", method).alias("verdict"), "trust", "distrust")


def oracle(rules: tuple[Rule, ...] = RULES, rounds: int = 8, damping: float = 0.85) -> str:
    """The same in SQL, a common table for each round."""
    ordered = sorted(rules, key=lambda r: (-len(str(r)), -len(r.host), str(r)))
    case = lambda f: " ".join(f"when (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}') then '{f(r)}'" for r in ordered)
    fold = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
    q = lambda s: s.replace("'", "''")
    parts = [
        f"u as (select page_id, html, {fold(f"coalesce(regexp_extract(url, '{HOST}', 1), '')")} as host, coalesce(regexp_extract(url, '{PATH}', 1), '') as path from pages)",
        f"j as (select *, case {case(lambda r: r.action)} end as action, case {case(str)} end as rule from u)",
        f"l as (select host as src, {fold(f"unnest(regexp_extract_all(html, '{q(LINK)}', 1))")} as dst from j where host <> '')",
        "e as (select src, dst, count(*) as n from l where src <> dst group by src, dst)",
        "s as (select src, dst, n / sum(n) over (partition by src) as fw, n / sum(n) over (partition by dst) as bw from e)",
        "o as (select host, count(*) filter (where action = 'allow') as a, count(*) filter (where action = 'block') as b from j where host <> '' group by host)",
        "nodes as (select host, coalesce(a, 0) / t.total as t0, coalesce(b, 0) / t.total as d0 from (select host from o union select src from e union select dst from e) h left join o using (host), (select greatest(1, sum(a + b))::double as total from o) t)",
        "r0 as (select host, t0 as trust, d0 as distrust from nodes)",
    ]
    for k in range(rounds):
        parts.append(f"g{k} as (select host, sum(t) as t, sum(d) as d from (select dst as host, trust * fw as t, 0.0 as d from r{k} join s on host = src union all select src, 0.0, distrust * bw from r{k} join s on host = dst) x group by host)")
        parts.append(f"r{k + 1} as (select nodes.host, case when (select count(*) from e) = 0 then t0 else {1 - damping} * t0 + {damping} * coalesce(t, 0) end as trust, case when (select count(*) from e) = 0 then d0 else {1 - damping} * d0 + {damping} * coalesce(d, 0) end as distrust from nodes left join g{k} on nodes.host = g{k}.host)")
    return f"with {', '.join(parts)} select page_id, j.host, path, rule, coalesce(action, case when distrust > trust then 'block' else 'allow' end) as verdict from j left join r{rounds} r on j.host = r.host"


ORACLE = oracle()
