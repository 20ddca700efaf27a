"""URL filters: rules by host and path, and a tree of path templates that learns which kinds of pages to reject."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallmat.llm.common import fresh, saved

ALLOW, BLOCK = "allow", "block"
ANY = "*"
# Segments of a path that get a level of the tree each; what lies deeper is one last segment.
DEPTH = 8
# Pages that a segment needs to stay a branch of its own, and the chi-square (two degrees of freedom, 1 %) at which it
# differs from its siblings.
SUPPORT, DIFFERENT = 5, 9.21
# Weight of a parent's purity, in labelled pages; that of a host's parent is NEUTRAL; purity at which pages are rejected.
STRENGTH, NEUTRAL, REJECT = 2.0, 0.5, 0.8


class Rule(NamedTuple):
    """A host with its subdomains and the beginning of a path."""

    verdict: str
    host: str
    path: str


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both are empty where it is null or has no ``://``."""
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def shape(path: Column) -> Column:
    """The segments of a path with numbers as ``#`` and long hexadecimal names as ``<hex>``; those beyond ``DEPTH`` are one."""
    parts = F.transform(
        F.slice(F.split(path, "/"), 2, F.lit(1 << 30)),
        lambda s: F.when(F.rlike(s, F.lit(r"^[0-9a-fA-F-]{16,}\z")), F.lit("<hex>")).otherwise(F.regexp_replace(s, "[0-9]+", "#")),
    )
    tail = F.array(F.array_join(F.slice(parts, DEPTH, F.lit(1 << 30)), "/"))
    return F.when(F.size(parts) <= DEPTH, parts).otherwise(F.concat(F.slice(parts, 1, DEPTH - 1), tail))


def ruled(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, both null where none does; rules are few and become one expression."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == rule.host) | F.endswith(host, F.lit(f".{rule.host}"))) & F.startswith(path, F.lit(rule.path))
        name, verdict = F.when(fits, rule.host + rule.path).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def templates(urls: DataFrame) -> DataFrame:
    """``(host, shape, template, pages, bad, good, purity, rejected)``: each kind of path with the template it falls under.

    ``urls`` has ``host``, ``shape`` and ``bad``: 1, 0, or null where a page is not labelled. Below a branch, segments with fewer
    than ``SUPPORT`` pages are variable and become a wildcard; so do those that are like their siblings, that is
    whose bad, good and unlabelled pages do not differ from those of all segments there by a chi-square test. An only
    segment stays. A template is rejected if it has labelled pages and its share of bad ones, smoothed towards that of its
    parent up to the host, is at least ``REJECT``.

    Pages are counted per kind of path first; the tree then grows by one level a round, in joins over these counts, so that
    neither a host nor a branch with many pages meets in one task. A literal ``*`` counts as a wildcard.
    """
    counts = saved(
        urls.groupBy("host", "shape").agg(
            F.count(F.lit(1)).alias("pages"), F.count_if(F.col("bad") == 1).alias("bad"), F.count_if(F.col("bad") == 0).alias("good")
        )
    )
    depth = counts.agg(F.coalesce(F.max(F.size("shape")), F.lit(0))).first()[0]
    now = counts.withColumn("prefix", F.array().cast("array<string>"))
    measures = ("pages", "bad", "good")
    for level in range(depth):
        here = now.withColumn("segment", F.get("shape", F.lit(level)))
        branches = here.where("segment IS NOT NULL").groupBy("host", "prefix", "segment").agg(*[F.sum(m).alias(m) for m in measures])
        siblings = branches.groupBy("host", "prefix").agg(
            *[F.sum(m).alias(f"all_{m}") for m in measures], F.count(F.lit(1)).alias("segments")
        )
        both = branches.join(siblings, ["host", "prefix"])
        size, total = F.col("pages").cast("double"), F.col("all_pages").cast("double")

        def part(seen: Column, everywhere: Column, size: Column = size, total: Column = total) -> Column:
            expected = size * everywhere / total
            return F.when(everywhere > 0, (seen - expected) * (seen - expected) / expected).otherwise(0.0)

        square = (
            part(F.col("bad"), F.col("all_bad"))
            + part(F.col("good"), F.col("all_good"))
            + part(F.col("pages") - F.col("bad") - F.col("good"), F.col("all_pages") - F.col("all_bad") - F.col("all_good"))
        )
        apart = (F.col("segments") == 1) | (square * total > DIFFERENT * (total - size))
        chosen = both.select("host", "prefix", "segment", F.when((F.col("pages") >= SUPPORT) & apart, F.col("segment")).otherwise(ANY).alias("branch"))
        grown = F.when(F.col("branch").isNull(), F.col("prefix")).otherwise(F.concat("prefix", F.array("branch")))
        now = saved(here.join(chosen, ["host", "prefix", "segment"], "left").select("host", "shape", *measures, grown.alias("prefix")))
    kinds = saved(now.groupBy("host", "prefix").agg(*[F.sum(m).alias(m) for m in measures]))
    purity = F.lit(NEUTRAL)
    for level in range(depth + 1):
        node = F.slice("prefix", 1, level) if level else F.array().cast("array<string>")
        sums = kinds.groupBy("host", node.alias("node")).agg(F.sum("bad").alias("bad_below"), F.sum("good").alias("good_below"))
        smoothed = (F.col("bad_below") + STRENGTH * purity) / (F.col("bad_below") + F.col("good_below") + STRENGTH)
        kinds = kinds.withColumn("node", node).join(sums, ["host", "node"]).select(
            "host", "prefix", *measures, F.when(F.size("prefix") >= level, smoothed).otherwise(purity).alias("purity")
        )
        purity = F.col("purity")
    rated = kinds.select(
        "host", "prefix", *[F.col(m).alias(f"of_{m}") for m in measures], "purity",
        ((F.col("bad") + F.col("good") > 0) & (F.col("purity") >= REJECT)).alias("rejected"),
    )
    return now.select("host", "shape", "prefix").join(rated, ["host", "prefix"]).select(
        "host",
        "shape",
        F.concat(F.lit("/"), F.array_join("prefix", "/")).alias("template"),
        *[F.col(f"of_{m}").alias(m) for m in measures],
        "purity",
        "rejected",
    )


def judge(pages: DataFrame, rules: Sequence[Rule] = (), labels: DataFrame | None = None) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, template, purity``: rules decide where one fits, else the page's template.

    ``labels`` holds ``page_id`` and ``bad`` (1 or 0; the larger of repeated ones) and teaches the templates; without it the
    pages that a rule decides do. Every page stays, repeated ones too. Null urls and those without ``://`` have empty host and
    path and form a template of their own. An empty table gives an empty one. Columns of ``pages`` with these names stay, and
    the new ones then begin with ``_``.
    """
    host, path, rule, verdict, template, purity, kind, bad, key, rejected, tree_host, tree_kind = fresh(
        pages, "host", "path", "rule", "verdict", "template", "purity", "shape", "bad", "label_id", "rejected", "tree_host", "tree_shape"
    )
    found_host, found_path = split_url(F.col("url"))
    parts = pages.select("*", found_host.alias(host), found_path.alias(path))
    name, decision = ruled(F.col(host), F.col(path), rules)
    told = parts.select("*", name.alias(rule), decision.alias(verdict), shape(F.col(path)).alias(kind))
    if labels is None:
        learned = told.select(F.col(host).alias("host"), F.col(kind).alias("shape"), F.when(F.col(verdict) == BLOCK, 1).when(F.col(verdict) == ALLOW, 0).alias("bad"))
    else:
        known = labels.where("page_id IS NOT NULL").groupBy(F.col("page_id").alias(key)).agg(F.max("bad").alias(bad))
        learned = told.join(known, F.col("page_id") == F.col(key), "left").select(
            F.col(host).alias("host"), F.col(kind).alias("shape"), F.col(bad).alias("bad")
        )
    names = {"host": tree_host, "shape": tree_kind, "template": template, "purity": purity, "rejected": rejected}
    tree = saved(templates(learned)).select(*[F.col(c).alias(n) for c, n in names.items()])
    decided = told.join(tree, (F.col(host) == F.col(tree_host)) & (F.col(kind) == F.col(tree_kind)), "left")
    return decided.select(
        *[F.col(f"`{c}`") for c in pages.columns],
        host,
        path,
        rule,
        F.coalesce(F.col(verdict), F.when(F.col(rejected), BLOCK).otherwise(ALLOW)).alias(verdict),
        template,
        purity,
    )
