"""URL filters: fixed rules first, then a path-template tree for each host that learns from what the rules say.

Equal URLs are counted once, so that a host with a third of all pages is a table of its distinct paths. The tree grows one path
segment a step. Under a node, a segment stays literal where it makes up a fair share of the node's pages; the rest is
variable and shares the wildcard ``*``. A node so has at most ``1 / support`` literal branches, whatever the host. Literal branches
with the same main kind of segment below them are merged, unless one differs from all of these taken together in what follows
it or in how often rules block it. Each branch's purity is the blocked share of its labelled pages, drawn to the purity of the node above it; pages that no
rule decides are blocked where their template's purity is high. All of it is DataFrame work: no Python sees a URL.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import LOWER, UPPER, shielded, written


class Rule(NamedTuple):
    """``verdict`` (allow or block) for a host with all its subdomains, where the URL's path starts with ``path``."""

    verdict: str
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
#: Segments of a path that have a level of the tree each; the last level holds all the rest as one segment.
LEVELS = 4
#: A literal branch holds at least this share and this number of its node's pages.
SUPPORT, LEAST = 0.05, 3
#: Labels that the purity of the node above counts for, and the purity from which a template is blocked.
WEIGHT, BLOCKED = 4.0, 0.7
#: What may follow a branch, in the order in which it is tried: the name and the pattern of the segment.
SHAPES = (
    ("number", "^[0-9]+$"),
    ("file", "^[^.]*[.][A-Za-z0-9]+$"),
    ("word", "^[A-Za-z]+$"),
    ("slug", "[-_]"),
    ("other", ""),
)
KINDS = ("end", *(name for name, _ in SHAPES))


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring_index(url, "://", 1))
    after = F.substr(url, F.length(rest) + 4)
    return F.coalesce(F.translate(F.regexp_extract(after, "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring_index(url, "://", 1))
    after = F.substr(url, F.length(rest) + 4)
    return F.coalesce(F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The number of the longest rule that fits, or null; of equally long ones the first."""
    found = F
    for k, rule in sorted(enumerate(rules), key=lambda x: (-len(str(x[1])), x[0])):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        found = found.when(fits, k)
    return found.otherwise(None) if rules else F.lit(None).cast("int")


def _shape(segment: Column) -> Column:
    kind = F.when(segment.isNull(), "end")
    for name, pattern in SHAPES:
        kind = kind.when(F.rlike(segment, F.lit(pattern)), name)
    return kind


def _purity(blocked: Column, labelled: Column, above: Column) -> Column:
    return (blocked + F.lit(WEIGHT) * above) / (labelled + F.lit(WEIGHT))


def _branches(state: DataFrame, support: float, least: int) -> DataFrame:
    """For each node that has a next segment: ``kept`` (literal segments, with branch and purity) and the wildcard's purity."""
    node = ["host", "template"]
    sums = ("n", "blocked", "labelled", *KINDS)
    kids = state.filter("child IS NOT NULL").groupBy(*node, "child").agg(
        F.max("purity").alias("purity"),
        *[F.sum(c).alias(c) for c in ("n", "blocked", "labelled")],
        *[F.sum(F.when(F.col("next") == k, F.col("n")).otherwise(0)).alias(k) for k in KINDS],
    )
    kids = written(kids, "url_branches")
    nodes = kids.groupBy(*node).agg(F.max("purity").alias("above"), *[F.sum(c).alias(f"all_{c}") for c in sums[:3]])
    literal = kids.filter(F.col("n") >= least).join(nodes.select(*node, "all_n"), node).filter(F.col("n") >= support * F.col("all_n"))
    most, main = F.greatest(*KINDS), F
    for k in KINDS:
        main = main.when(F.col(k) == F.col("most"), k)
    # At most 1 / support of them a node; those with the same main kind of next segment are compared with each other's sum.
    literal = written(literal.withColumn("most", most).withColumn("main", main), "url_literal")
    pools = literal.groupBy(*node, "main").agg(*[F.sum(c).alias(f"pool_{c}") for c in sums])
    apart = sum((F.abs(F.col(k) / F.col("n") - F.col(f"pool_{k}") / F.col("pool_n")) for k in KINDS), F.lit(0.0)) / 2
    rate, noise = F.col("pool_blocked") / F.col("pool_labelled"), 2.0 * F.sqrt(F.lit(1.0) / F.col("labelled"))
    same_rate = F.when((F.col("labelled") == 0) | (F.col("pool_labelled") == 0), True).otherwise(
        F.abs(F.col("blocked") / F.col("labelled") - rate) <= noise * F.sqrt(rate * (1 - rate))
    )
    alike = (apart <= 0.1 + F.lit(1.0) / F.sqrt("n")) & same_rate
    known = literal.join(pools, [*node, "main"]).select(*node, "main", "child", "purity", "blocked", "labelled", alike.alias("alike"))
    merged = known.filter("alike").groupBy(*node, "main").agg(
        F.array_join(F.sort_array(F.collect_list("child")), "|").alias("names"), F.count("*").alias("merged"),
        F.sum("blocked").alias("m_blocked"), F.sum("labelled").alias("m_labelled"),
    )
    known = known.join(merged.filter("merged > 1"), [*node, "main"], "left")
    joins = F.col("alike") & F.col("merged").isNotNull()
    of = [F.when(joins, F.col(f"m_{c}")).otherwise(F.col(c)) for c in ("blocked", "labelled")]
    branch = F.when(joins, F.concat(F.lit("{"), "names", F.lit("}"))).otherwise(F.col("child"))
    kept = F.struct("child", branch.alias("branch"), _purity(*of, F.col("purity")).alias("purity"))
    kept = known.groupBy(*node).agg(F.collect_list(kept).alias("kept"), F.sum("blocked").alias("known_blocked"), F.sum("labelled").alias("known_labelled"))
    wild = [F.col(f"all_{c}") - F.coalesce(f"known_{c}", F.lit(0)) for c in ("blocked", "labelled")]
    return nodes.join(kept, node, "left").select(*node, "kept", _purity(*wild, F.col("above")).alias("wild_purity"))


def learn(paths: DataFrame, levels: int = LEVELS, support: float = SUPPORT, least: int = LEAST) -> DataFrame:
    """``host``, ``path``, ``template``, ``purity`` of each row of ``paths`` (``host``, ``path``, ``n``, ``blocked``, ``labelled``; one row a path).

    Without any label every purity is zero.
    """
    paths = paths.withColumn("segments", F.filter(F.split("path", "/"), lambda s: s != ""))
    known = paths.agg(F.sum("blocked"), F.sum("labelled"), F.max(F.size("segments"))).first()
    prior = known[0] / known[1] if known[1] else 0.0
    hosts = paths.groupBy("host").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l"))
    hosts = written(hosts.select("host", _purity(F.col("b"), F.col("l"), F.lit(prior)).alias("purity")), "url_hosts")
    state = paths.withColumn("template", F.lit("")).join(hosts, "host")
    for k in range(min(levels, known[2] or 0)):
        last = k == levels - 1

        def segment(at: int, rest: bool) -> Column:
            held = F.array_join(F.slice("segments", at + 1, F.size("segments")), "/") if rest else F.get("segments", F.lit(at))
            return F.when(F.size("segments") > at, held)

        after = F.lit(None).cast("string") if last else segment(k + 1, k + 1 == levels - 1)
        state = written(state.withColumns({"child": segment(k, last), "next": _shape(after)}), "url_state")
        found = written(_branches(state, support, least), "url_tree")
        state = state.join(found, ["host", "template"], "left")
        state = state.withColumn("hit", F.get(F.filter("kept", lambda x: x["child"] == F.col("child")), F.lit(0)))
        grown = F.concat("template", F.lit("/"), F.coalesce("hit.branch", F.lit("*")))
        state = state.select(
            "host", "path", "segments", "n", "blocked", "labelled",
            F.when(F.col("child").isNull(), F.col("template")).otherwise(grown).alias("template"),
            F.when(F.col("child").isNull(), F.col("purity")).otherwise(F.coalesce("hit.purity", "wild_purity")).alias("purity"),
        )
    return state.select("host", "path", "template", "purity")


def judge(pages: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES, levels: int = LEVELS) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (text of the longest rule that fits, else null), ``template``, ``purity`` and ``verdict``.

    Null URLs and such without ``://`` have an empty host and path; they share one template and are judged like any other. Repeated
    rows count once each and have equal results. Own columns of these names are replaced.
    """
    added = ("host", "path", "rule", "template", "purity", "verdict")
    keep = [c for c in pages.columns if c not in added]
    rows, names = shielded(pages)
    held = F.col(names[url])
    rows = rows.select(*[names[c] for c in keep], host_of(held).alias("host"), path_of(held).alias("path"))
    rows = rows.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    of = {k: r for k, r in enumerate(rules)}
    blocks = F.col("fit").isin([k for k, r in of.items() if r.verdict == "block"])
    paths = rows.groupBy("host", "path").agg(
        F.count("*").alias("n"),
        F.count(F.when(blocks, 1)).alias("blocked"),
        F.count("fit").alias("labelled"),
    )
    found = written(learn(written(paths, "url_paths"), levels), "url_templates")
    out = rows.join(found, ["host", "path"])

    def named(value) -> Column:
        chosen = F
        for k, r in of.items():
            chosen = chosen.when(F.col("fit") == k, value(r))
        return chosen.otherwise(None) if of else F.lit(None).cast("string")

    verdict = F.coalesce(named(lambda r: r.verdict), F.when(F.col("purity") >= BLOCKED, "block").otherwise("allow"))
    return out.select(
        *[F.col(names[c]).alias(c) for c in keep], "host", "path", named(str).alias("rule"), "template", "purity", verdict.alias("verdict")
    )
