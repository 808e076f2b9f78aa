"""Blocking strategies: each a function (s1, pool) -> distinct (s1_id, cand_id), as equi-joins.

pool is the union of the candidate sources with `candidate_source`. Keys are built once
for either side; frequency caps come from counts of the pool and drop the key before
the join, which also removes the heaviest keys. Names, postal codes and numbers have no cap: they
give every pair, however many. Where all strategies are combined, over more than HOT records, the pairs are made in tiles,
and only the best of each record (or counts) leave a tile.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entwine.functions.session import bounded, stored
from entwine.operators import tiles
from entwine.schema import MAX_BLOCK_FREQUENCY, MAX_CANDIDATES, MIN_NGRAM_DOCUMENTS, MIN_TOKEN_LENGTH, NGRAM_RANGE, STRATEGIES, STRATEGY_WEIGHTS, TOP_K_NGRAM

Strategy = Callable[[DataFrame, DataFrame], DataFrame]

#: Records of either side up to which strategies are joined one by one, without tiles.
HOT = 1000
#: Pairs that union() has in a tile, about.
TILE_PAIRS = 1_000_000
#: Pairs of postings up to which all n-grams are joined at once, without tiles.
PLAIN = 1_000_000
#: Tasks that count n-grams, at least.
PARTS = 12
#: Names of a tile whose similarities are summed first, before those of the next.
FIRST = 256


def candidate_pool(s2: DataFrame, s3: DataFrame) -> DataFrame:
    """s2, and the records of s3 whose id s2 lacks, with candidate_source; one row an id."""
    rest = s3.join(s2.select("entity_id"), "entity_id", "left_anti")
    both = s2.withColumn("candidate_source", F.lit("s2")).unionByName(rest.withColumn("candidate_source", F.lit("s3")))
    return both.dropDuplicates(["entity_id"])


def _keys(records: DataFrame, name: str, keys: Column, *more: str) -> DataFrame:
    return records.select(F.col("entity_id").alias(name), *more, F.explode(F.array_distinct(keys)).alias("key"))


def _match(s1: DataFrame, pool: DataFrame, *on: str) -> DataFrame:
    return s1.join(pool, list(on)).select("s1_id", "cand_id").distinct()


def _names() -> Column:
    return F.filter(F.array("business_name_normalized", "business_name_core"), lambda x: x != "")


def _postal_codes() -> Column:
    return F.filter(F.array("business_address_postal"), lambda x: x != "")


def _numbers() -> Column:
    return F.col("business_address_numeric_tokens")


def exact_name(s1: DataFrame, pool: DataFrame) -> DataFrame:
    """Normalised or core name of one equal to normalised or core name of the other."""
    return _match(_keys(s1, "s1_id", _names()), _keys(pool, "cand_id", _names()), "key")


def country_name_token(s1: DataFrame, pool: DataFrame, cap: int = MAX_BLOCK_FREQUENCY) -> DataFrame:
    """A name token in one country; a token's frequency counts its occurrences, also within one name."""
    long = F.filter("business_name_tokens", lambda t: F.length(t) >= MIN_TOKEN_LENGTH)
    there = pool.where("country_normalized <> ''")
    usual = there.select("country_normalized", F.explode(long).alias("key")).groupBy("country_normalized", "key").count().where(F.col("count") <= cap)
    mine, theirs = (_keys(x, n, long, "country_normalized") for x, n in ((s1, "s1_id"), (there, "cand_id")))
    return _match(mine, theirs.join(usual, ["country_normalized", "key"], "left_semi"), "country_normalized", "key")


def postal(s1: DataFrame, pool: DataFrame) -> DataFrame:
    return _match(_keys(s1, "s1_id", _postal_codes()), _keys(pool, "cand_id", _postal_codes()), "key")


def address_token(s1: DataFrame, pool: DataFrame, cap: int = MAX_BLOCK_FREQUENCY) -> DataFrame:
    """An address token; its frequency counts records."""
    long = F.filter("business_address_tokens", lambda t: F.length(t) >= MIN_TOKEN_LENGTH)
    theirs = _keys(pool, "cand_id", long)
    usual = theirs.groupBy("key").count().where(F.col("count") <= cap)
    return _match(_keys(s1, "s1_id", long), theirs.join(usual, "key", "left_semi"), "key")


def numeric_address(s1: DataFrame, pool: DataFrame) -> DataFrame:
    return _match(_keys(s1, "s1_id", _numbers()), _keys(pool, "cand_id", _numbers()), "key")


def _long(column: str) -> Column:
    return F.filter(column, lambda t: F.length(t) >= MIN_TOKEN_LENGTH)


def _country_tokens() -> Column:
    return F.when(F.col("country_normalized") != "", F.transform(_long("business_name_tokens"), lambda t: F.concat("country_normalized", F.lit("\n"), t))).otherwise(F.array().cast("array<string>"))


def _address_tokens() -> Column:
    return _long("business_address_tokens")


@dataclass(frozen=True)
class Keyed:
    """A strategy that is equality of keys; of which those that are counted more than cap times in the pool are left out."""

    strategy: Strategy
    keys: Callable[[], Column]
    counted: Callable[[], Column] | None = None
    cap: int | None = None


KEYED: dict[str, Keyed] = {
    "exact_name": Keyed(exact_name, _names),
    "country_name_token": Keyed(country_name_token, _country_tokens, _country_tokens, MAX_BLOCK_FREQUENCY),
    "postal": Keyed(postal, _postal_codes),
    "address_token": Keyed(address_token, _address_tokens, lambda: F.array_distinct(_address_tokens()), MAX_BLOCK_FREQUENCY),
    "numeric_address": Keyed(numeric_address, _numbers),
}


def char_ngrams(text: Column, low: int = NGRAM_RANGE[0], high: int = NGRAM_RANGE[1]) -> Column:
    """All character n-grams, repeats included."""
    grams = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.concat(*[grams(n) for n in range(low, high + 1)])


def char_ngram_scores(s1: DataFrame, pool: DataFrame, top: int = TOP_K_NGRAM) -> DataFrame:
    """(s1_id, cand_id, similarity, rank): the nearest pool records by cosine of n-gram TF-IDF of the name.

    idf = ln((1 + N) / (1 + df)) + 1 with N and df over
    all pool records; n-grams of fewer than MIN_NGRAM_DOCUMENTS records are left out before
    the lengths are taken. Order: similarity to 9 places, then id.

    Equal names have equal vectors, so the search is between distinct names, by number; of a pool name the
    first `top` ids are all that can be needed. Beyond PLAIN pairs of postings, blocks of names meet in tiles, which
    return a name's nearest `top`: all pairs are summed, and none but these is shuffled.
    """
    total = pool.count()
    parts = max(int(s1.sparkSession.conf.get("spark.sql.shuffle.partitions")), PARTS)
    named = pool.select(F.col("business_name_normalized").alias("name"), "entity_id")
    in_name = Window.partitionBy("name").orderBy("entity_id")
    least_ids = named.withColumn("n", F.row_number().over(in_name)).where(F.col("n") <= top).groupBy("name").agg(F.array_sort(F.collect_list("entity_id")).alias("ids"))
    names = named.where("name <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("records")).join(least_ids, "name")
    # numbered in order of the least id, to which ties go
    names = stored(names.withColumn("least", F.element_at("ids", 1)), "ngram-names")
    names = stored(names.orderBy("least").withColumn("p", F.monotonically_increasing_id()).drop("least"), "ngram-numbers")
    asked = s1.where("business_name_normalized <> ''").select("entity_id", F.col("business_name_normalized").alias("name"))
    wanted = stored(asked.select("name").distinct().withColumn("q", F.monotonically_increasing_id()), "ngram-asked")
    # dealt out by number: names are short, their n-grams many
    count = lambda df, *by: df.repartition(parts, by[0]).select(*by, F.explode(char_ngrams(F.col("name"))).alias("gram")).groupBy(*by, "gram").agg(F.count(F.lit(1)).alias("n"))
    tf = count(names, "p", "records")
    df = tf.groupBy("gram").agg(F.sum("records").alias("df"), F.count(F.lit(1)).alias("names")).where(F.col("df") >= MIN_NGRAM_DOCUMENTS)
    idf = df.select("gram", "names", (F.log((1 + F.lit(float(total))) / (1 + F.col("df"))) + 1).alias("idf"))
    idf = stored(idf.withColumn("g", F.monotonically_increasing_id()), "ngram-idf")
    kept = bounded(idf)

    def unit(counts: DataFrame, *by: str) -> DataFrame:
        """v: the vector of each name as a list of (g, w), g the number of an n-gram."""
        weighed = counts.join(kept, "gram").withColumn("w", F.col("n") * F.col("idf"))
        length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(by[0])))
        return weighed.withColumn("w", F.col("w") / length).groupBy(*by).agg(F.collect_list(F.struct("g", "w")).alias("v"), F.sum("names").alias("names"))

    right = stored(unit(tf, "p").drop("names"), "ngram-pool")
    left = stored(unit(count(wanted, "q"), "q"), "ngram-left")
    postings, mine = (x or 0 for x in left.agg(F.sum("names"), F.sum(F.size("v"))).first())
    theirs = idf.agg(F.sum("names")).first()[0] or 0
    if postings <= PLAIN:
        # by q before the join: what follows needs no other partitioning; the number keeps few, small rows from becoming one task
        similar = _all_similar(left.repartition(parts, "q").select("q", F.inline("v")), bounded(right.select("p", F.inline("v").alias("g", "v"))))
    else:
        side = lambda df, i: df.select(F.col(i).alias("id"), "v")
        similar = tiles.tiled(side(left, "q"), side(right, "p"), tiles.nearest(top, FIRST), tiles.NEAREST, (mine, theirs))
    similar = similar.withColumn("similarity", F.round("similarity", 9)).where("similarity > 0")
    # the nearest names first: each name brings at least one id, so `top` names are enough
    near_names = Window.partitionBy("q").orderBy(F.desc("similarity"), F.element_at("ids", 1))
    similar = similar.join(bounded(names.select("p", "ids")), "p").withColumn("n", F.rank().over(near_names)).where(F.col("n") <= top)
    each = Window.partitionBy("q").orderBy(F.desc("similarity"), "cand_id")
    ranked = similar.select("q", "similarity", F.explode("ids").alias("cand_id")).withColumn("rank", F.row_number().over(each)).where(F.col("rank") <= top)
    return asked.join(bounded(wanted), "name").join(ranked, "q").select(F.col("entity_id").alias("s1_id"), "cand_id", "similarity", "rank")


def _all_similar(left: DataFrame, right: DataFrame) -> DataFrame:
    """(q, p, similarity) of all names that share an n-gram."""
    return left.join(right, "g").groupBy("q", "p").agg(F.sum(F.col("w") * F.col("v")).alias("similarity"))


def char_ngram(s1: DataFrame, pool: DataFrame) -> DataFrame:
    return char_ngram_scores(s1, pool).select("s1_id", "cand_id").distinct()


REGISTRY: dict[str, Strategy] = {
    "exact_name": exact_name,
    "country_name_token": country_name_token,
    "postal": postal,
    "address_token": address_token,
    "numeric_address": numeric_address,
    "char_ngram": char_ngram,
}


def register(name: str, strategy: Strategy) -> None:
    """Add a strategy of the caller's; its weight in the union is 1."""
    REGISTRY[name] = strategy


def by_strategy(s1: DataFrame, pool: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(s1_id, cand_id, strategy) of all strategies."""
    out = None
    for name in names or list(REGISTRY):
        found = REGISTRY[name](s1, pool).withColumn("strategy", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out


def combine(found: DataFrame, limit: int = MAX_CANDIDATES) -> DataFrame:
    """(s1_id, cand_id, strategy) -> (s1_id, cand_id, score, rank, provenance): weights summed, the best `limit` of each s1_id.

    provenance lists the strategies in their order; ties of score go to the lesser id.
    """
    weights = F.create_map(*[F.lit(v) for pair in STRATEGY_WEIGHTS.items() for v in pair])
    places = F.create_map(*[F.lit(v) for i, s in enumerate(STRATEGIES) for v in (s, i)])
    found = found.distinct()
    weight = F.coalesce(F.try_element_at(weights, F.col("strategy")), F.lit(1))
    place = F.coalesce(F.try_element_at(places, F.col("strategy")), F.lit(len(STRATEGIES)))
    merged = found.groupBy("s1_id", "cand_id").agg(
        F.sum(weight).cast("int").alias("score"),
        F.transform(F.array_sort(F.collect_list(F.struct(place.alias("place"), "strategy"))), lambda x: x["strategy"]).alias("provenance"),
    )
    best = Window.partitionBy("s1_id").orderBy(F.desc("score"), "cand_id")
    return merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).select("s1_id", "cand_id", "score", "rank", "provenance")


class Sharing:
    """What the records of s1 and of a pool share, by strategies: keys of either side, of which tiles.py makes the pairs.

    A strategy of KEYED is its keys; of any other the pairs are, the candidates as keys. ids of several records are united.
    truth: rows of s1_id and a list of cand_id, as one more column that has no weight.
    """

    def __init__(self, s1: DataFrame, pool: DataFrame, names: list[str], truth: DataFrame | None = None):
        places = {n: i for i, n in enumerate(STRATEGIES)}
        self.names = sorted(set(names), key=lambda n: (places.get(n, len(STRATEGIES)), n))
        self.columns = [f"k{i}" for i in range(len(self.names) + (truth is not None))]
        self.weights = [STRATEGY_WEIGHTS.get(n, 1) for n in self.names] + [0] * (truth is not None)
        self.truth = len(self.names) if truth is not None else None
        self.hot: list[list[str]] = [[] for _ in self.columns]
        keyed = {k: KEYED[n] for k, n in enumerate(self.names) if n in KEYED and REGISTRY.get(n) is KEYED[n].strategy}
        own = F.array("entity_id")
        side = lambda df, given, rest: df.select(F.col("entity_id").alias("id"), *[given.get(k, rest).alias(c) for k, c in enumerate(self.columns)])
        none = F.array().cast("array<string>")
        keys = {k: x.keys() for k, x in keyed.items()}
        left, right = side(s1, keys, none), side(pool, keys, own)
        for k, x in keyed.items():
            if x.cap is not None:
                counts = pool.select(F.explode(x.counted()).alias("key")).groupBy("key").count()
                self.hot[k] = [r["key"] for r in counts.where(F.col("count") > x.cap).select("key").collect()]
        pair = lambda df, k, keys: df.select("id", *[(keys if i == k else none).alias(c) for i, c in enumerate(self.columns)])
        for k, n in enumerate(self.names):
            if k not in keyed:
                found = stored(REGISTRY[n](s1, pool).select("s1_id", "cand_id"), "pairs")
                left = left.unionByName(pair(found.withColumnRenamed("s1_id", "id"), k, F.array("cand_id")))
                if REGISTRY[n] is not char_ngram:  # another may find what is not in the pool
                    right = right.unionByName(pair(found.select(F.col("cand_id").alias("id")).distinct(), k, F.array("id")))
        if truth is not None:
            left = left.unionByName(pair(truth.withColumnRenamed("s1_id", "id"), self.truth, F.col("cand_ids")))
        united = lambda df, name: stored(df.where("id IS NOT NULL").groupBy("id").agg(*[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in self.columns]), name)
        self.left, self.right = united(left, "keys-s1"), united(right, "keys-pool")

    def _tiled(self, schema: str, tiles_least: int = 0, **how: int | None) -> DataFrame:
        size = sum((F.size(c) for c in self.columns), F.lit(0))
        sizes = tuple(df.agg(F.sum(size)).first()[0] or 0 for df in (self.left, self.right))
        return tiles.tiled(self.left, self.right, tiles.sharing(self.columns, self.weights, self.hot, **how), schema, sizes, tiles_least)

    def _shown(self, found: DataFrame) -> DataFrame:
        met = [(F.col("bits").bitwiseAND(F.lit(1 << k).cast("long")) != 0, n, self.weights[k]) for k, n in enumerate(self.names)]
        score = sum((F.when(has, weight).otherwise(0) for has, _, weight in met), F.lit(0)).cast("int")
        return found.withColumns({"score": score, "provenance": F.array_compact(F.array(*[F.when(has, F.lit(n)) for has, n, _ in met]))})

    def best(self, limit: int) -> DataFrame:
        """As combine()."""
        return self._shown(self._tiled(tiles.FOUND, limit=limit)).select("s1_id", "cand_id", "score", "rank", "provenance")

    def all(self) -> DataFrame:
        """(s1_id, cand_id, score, provenance) of all pairs; the more there are, the more tiles."""
        count = lambda df, c, k: df.select(F.explode(c).alias("key")).where(~F.col("key").isin(self.hot[k]) if self.hot[k] else F.lit(True)).groupBy("key").count()
        pairs = 0
        for k, c in enumerate(self.columns):
            both = count(self.left, c, k).join(count(self.right, c, k).withColumnRenamed("count", "n"), "key")
            pairs += both.agg(F.sum(F.col("count") * F.col("n"))).first()[0] or 0
        return self._shown(self._tiled(tiles.FOUND, -(-pairs // TILE_PAIRS))).select("s1_id", "cand_id", "score", "provenance")

    def recall(self) -> DataFrame:
        """(strategy, pairs, hits, recall): pairs of each strategy, how many of them are in truth, and of all of truth."""
        true = self.left.agg(F.sum(F.size(self.columns[self.truth]))).first()[0] or 0
        counts = self._tiled(tiles.COUNTED, truth=self.truth).groupBy("k").agg(F.sum("pairs").alias("pairs"), F.sum("hits").alias("hits"))
        strategy = F.element_at(F.array(*map(F.lit, self.names)), F.col("k") + 1)
        return counts.where((F.col("k") < len(self.names)) & (F.col("pairs") > 0)).select(strategy.alias("strategy"), "pairs", "hits", (F.col("hits") / F.lit(float(max(1, true)))).alias("recall"))


def _few(s1: DataFrame, pool: DataFrame) -> bool:
    """Whether the pairs are few, so that strategies can be joined and combined one by one."""
    return all(df.limit(HOT + 1).count() <= HOT for df in (s1, pool))


def candidates(s1: DataFrame, s2: DataFrame, s3: DataFrame, names: list[str] | None = None, limit: int = MAX_CANDIDATES) -> DataFrame:
    """Combined candidates of all strategies over normalised sources, the best `limit` of each record of s1."""
    pool, names = candidate_pool(s2, s3), names or list(REGISTRY)
    return combine(by_strategy(s1, pool, names), limit) if _few(s1, pool) else Sharing(s1, pool, names).best(limit)


def union(s1: DataFrame, pool: DataFrame, names: list[str]) -> DataFrame:
    """(s1_id, cand_id, score, provenance) of all pairs of the strategies."""
    return combine(by_strategy(s1, pool, names), 1 << 30).drop("rank") if _few(s1, pool) else Sharing(s1, pool, names).all()


def strategy_recall(s1: DataFrame, pool: DataFrame, names: list[str], truth: DataFrame) -> DataFrame:
    """As metrics.strategy_recall of all pairs of the strategies; truth: s1_id and a list of cand_ids, rows of one id are united."""
    return Sharing(s1, pool, names, truth).recall()
