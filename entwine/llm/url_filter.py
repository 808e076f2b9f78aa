"""URL filters: link-graph propagation.

A url is judged by the longest rule that fits it. Urls without a rule are judged by
their host's place in the graph of links between hosts: trust is personalised PageRank
from the hosts with allowed pages, distrust the same over the reversed edges from hosts
with blocked pages (whoever links to a blocked host is distrusted). Seeds weigh as many
pages as a rule decided on the host; each round a host has (1 - DAMPING) of its seed and
DAMPING of what its neighbours pass on, each neighbour dividing its rank by the pages that link.
The registered query, as its SQL, does
ROUNDS rounds; with a tolerance, rounds go on until three of them change trust and distrust, summed over
all hosts, by no more than that share of the seeds.
What a host without links would pass on is lost. Ranks meet pages and links by broadcast while there are no more hosts than SMALL;
beyond, hosts that have more than a HEAVYth of the rows (at most HEAVY of them) are still broadcast and only the others shuffled. A host is blocked if its distrust is
more than RATIO times its trust, else allowed; so is a host without any.

Defined results. Null url, and url without `://`: host and path empty, no rule fits,
allowed. Null html: no links. An empty table gives an empty result; repeated rows
each get a row and each count. Extra columns are not read and can have any name.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entwine.functions.session import stored

RULES = ("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/")
DAMPING, ROUNDS, RATIO = 0.85, 10, 1.0
SMALL, HEAVY = 1_000_000, 10_000
MAX_RULES = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)(?:href|src)\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: tuple[str, ...] = RULES) -> tuple[Column, Column]:
    """(rule without its verdict, verdict) of the longest rule that fits; of equally long ones the later in the list; nulls if none fits."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.split(" ", 1)[1])):
        decision, place = rule.split(" ", 1)
        domain, _, start = place.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + start)
        text, verdict = F.when(fits, F.lit(place)).otherwise(text), F.when(fits, F.lit(decision)).otherwise(verdict)
    return text, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, pages): how many pages (host, html) of a host link to another host."""
    links = pages.select("host", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))).alias("link"))
    target = host_of(F.concat(F.when(F.col("link").startswith("//"), F.lit("x:")).otherwise(""), F.col("link")))
    edges = links.select(F.col("host").alias("src"), target.alias("dst")).where("src <> '' AND dst <> '' AND src <> dst")
    return edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("pages"))


def _heavy(rows: DataFrame, host: str, n: str) -> DataFrame:
    """(heavy): the hosts that have more than a HEAVYth of the sum of n, of rows that have a host once each."""
    total = rows.agg(F.sum(n)).first()[0] or 0
    return rows.where(F.col(n) * HEAVY > total).select(F.col(host).alias("heavy"))


def _meet(many: DataFrame, ranks: DataFrame, by: str, small: bool, heavy: DataFrame, how: str = "inner") -> DataFrame:
    """many joined with ranks (host, ...) by its column by; heavy: hosts that have very many rows there."""
    if small:
        return many.join(F.broadcast(ranks), F.col(by) == F.col("host"), how).drop("host")
    marked = many.join(F.broadcast(heavy), F.col(by) == F.col("heavy"), "left")
    of_heavy = F.broadcast(ranks.join(F.broadcast(heavy), F.col("host") == F.col("heavy"), "left_semi"))
    parts = [marked.where(f"heavy IS {'NOT ' * (r is of_heavy)}NULL").drop("heavy").join(r, F.col(by) == F.col("host"), how).drop("host") for r in (of_heavy, ranks)]
    return parts[0].unionByName(parts[1])


def _spread(ranks: DataFrame, edges: DataFrame, by: str, to: str, rank: str, out: str, small: bool, heavy: DataFrame) -> DataFrame:
    moved = _meet(edges, ranks.select("host", rank), by, small, heavy)
    return moved.groupBy(F.col(to).alias("host")).agg(F.sum(F.col(rank) * F.col(f"share_{by}")).alias(out))


def propagate(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, tolerance: float | None = None) -> DataFrame:
    """(host, allowed, blocked) and (src, dst, pages) -> (host, trust, distrust) of every host of either table.

    tolerance: if given, as many rounds as it takes (see above) instead of rounds.
    """
    edges = stored(edges, "uf-edges")
    none = edges.isEmpty()
    nodes = seeds if none else seeds.unionByName(edges.select(F.explode(F.array("src", "dst")).alias("host"), F.lit(0).alias("allowed"), F.lit(0).alias("blocked")))
    nodes = stored(nodes.groupBy("host").agg(F.sum("allowed").cast("double").alias("allowed"), F.sum("blocked").cast("double").alias("blocked")), "uf-hosts")
    start = lambda c: F.lit(1 - damping) * F.col(c)
    if none:
        return nodes.select("host", start("allowed").alias("trust"), start("blocked").alias("distrust"))
    small, heavy = nodes.limit(SMALL + 1).count() <= SMALL, {}
    for by in ("src", "dst"):
        sums = stored(edges.groupBy(F.col(by).alias("host")).agg(F.sum("pages").alias("all"), F.count(F.lit(1)).alias("links")), "uf-sums")
        heavy[by] = stored(_heavy(sums, "host", "links"), "uf-heavy")
        edges = _meet(edges, sums.select("host", "all"), by, small, heavy[by]).withColumn(f"share_{by}", F.col("pages") / F.col("all")).drop("all")
    edges = stored(edges, "uf-shares")
    ranks = nodes.select("host", start("allowed").alias("trust"), start("blocked").alias("distrust"))
    last, seeded = ranks, nodes.agg(F.sum(F.col("allowed") + F.col("blocked"))).first()[0] if tolerance is not None else 0
    for i in range(rounds) if tolerance is None else count():
        passed = nodes.join(_spread(ranks, edges, "src", "dst", "trust", "t", small, heavy["src"]), "host", "left")
        passed = passed.join(_spread(ranks, edges, "dst", "src", "distrust", "d", small, heavy["dst"]), "host", "left")
        more = lambda c: F.lit(damping) * F.coalesce(c, F.lit(0.0))
        ranks = passed.select("host", (start("allowed") + more("t")).alias("trust"), (start("blocked") + more("d")).alias("distrust"))
        if i % 3 == 2:
            ranks = stored(ranks, "uf-ranks")
            if tolerance is not None:
                was = last.select("host", F.col("trust").alias("t"), F.col("distrust").alias("d"))
                if ranks.join(was, "host").agg(F.sum(F.abs(F.col("trust") - F.col("t")) + F.abs(F.col("distrust") - F.col("d")))).first()[0] <= tolerance * seeded:
                    break
                last = ranks
    return ranks


def judge(pages: DataFrame, rules: tuple[str, ...] = RULES, tolerance: float | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every row of pages (page_id, url, html); tolerance: as in propagate()."""
    read = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    read = read.withColumn("rule", rule).withColumn("decided", verdict)
    one = lambda v: F.count_if(F.col("decided") == v)
    seeds = read.where("host <> ''").groupBy("host").agg(one("allow").alias("allowed"), one("block").alias("blocked"), F.count(F.lit(1)).alias("pages"))
    seeds = stored(seeds, "uf-seeds")
    ranks = stored(propagate(seeds.drop("pages"), host_edges(read), tolerance=tolerance), "uf-ranks")
    heavy = stored(_heavy(seeds, "host", "pages"), "uf-heavy")
    mine = read.drop("html").withColumnRenamed("host", "page_host")
    out = _meet(mine, ranks, "page_host", ranks.limit(SMALL + 1).count() <= SMALL, heavy, "left").withColumnRenamed("page_host", "host")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    by_host = F.when(distrust > F.lit(RATIO) * trust, "block").otherwise("allow")
    return out.select(
        "page_id", "host", "path", "rule", F.coalesce("decided", by_host).alias("verdict"), F.round(trust, 6).alias("trust"), F.round(distrust, 6).alias("distrust")
    )
