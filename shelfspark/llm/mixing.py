"""Mixing sources to target weights: min-cost flow over membership patterns, then seeded selection of documents."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize, ship
from .common import components, packed, table

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
BUCKETS = 4096      # hash ranges of a pattern, whose sums are folded before documents are placed
PER_CLASS = 64      # documents of each size class that may fill, in one round, what whole documents leave of a target
NEAR = 0.002        # share of a target that may stay unfilled; rounds go on until it is reached or nothing fits
SLICES = 16         # of the buckets of a source, in which candidates are ranked first
MOST_SENT = 1 << 18  # rows of (source, bucket, copies) that are broadcast, some tens of MB; more are joined
SEED = 42


def word_count(text: Column) -> Column:
    """Runs without ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


# ------------------------------------------------------------------ targets
def ranked(sources: DataFrame) -> DataFrame:
    """sources with place: 0, 1, ... by code point of `source`, null last.  Ranges are numbered apart and then shifted, so no
    task sorts all of them."""
    spark = sources.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(sources.repartitionByRange(parts, F.col("source").isNull(), "source").withColumn("part", F.spark_partition_id()), "mix_ranges")
    sizes = {r[0]: r[1] for r in dealt.groupBy("part").count().collect()}  # one row per range
    before, start = 0, {}
    for part in sorted(sizes):
        start[part] = before
        before += sizes[part]
    if not start:
        return dealt.drop("part").withColumn("place", F.lit(0).cast("long"))
    shift = F.create_map(*[F.lit(x) for kv in start.items() for x in kv])[F.col("part")]
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").isNull(), "source"))
    return dealt.withColumn("place", (own - 1 + shift).cast("long")).drop("part")


def weighted_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """sources(source, size) with target: all sizes shared by the repeating weights; a target stops at `most` times its
    source's size and the excess is shared again by weight until none is above.

    The share per unit of weight only grows while sources are capped, so each round is one sum over the sources.
    """
    rows = ranked(sources).withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
    rows = materialize(rows.withColumn("cap", F.col("size") * F.lit(float(most))), "mix_sources")
    whole, weight = rows.agg(F.sum("size"), F.sum("w")).first()
    if not whole:
        return rows.select("source", "size", F.lit(0.0).alias("target"))
    share = whole / weight
    while True:
        capped, free = rows.agg(F.sum(F.when(F.col("cap") <= F.col("w") * share, F.col("cap"))), F.sum(F.when(F.col("cap") > F.col("w") * share, F.col("w")))).first()
        new = (whole - (capped or 0.0)) / free if free else share
        if new <= share:
            return rows.select("source", "size", F.least("cap", F.col("w") * share).alias("target"))
        share = new


# ------------------------------------------------------------------ flow
def min_cost_routes(capacity: list[int], members: list[list[int]], quota: list[int], most: int = MOST_COPIES) -> dict[tuple[int, int], int]:
    """Words from each pattern to each of its sources, (pattern, source) -> words, at the least cost of repetition.

    A pattern gives its capacity up to `most` times; the r-th time costs 2 r - 1 per word (convex: r^2 in all), so repetition is
    spread evenly.  Successive shortest paths with potentials; among equal costs the smaller node is taken.
    """
    p, s = len(capacity), len(quota)
    start, end = p + s, p + s + 1
    edges: list[list[int]] = []  # to, room, cost
    out: list[list[int]] = [[] for _ in range(p + s + 2)]

    def arc(a: int, b: int, room: int, cost: int) -> None:
        out[a].append(len(edges))
        edges.append([b, room, cost])
        out[b].append(len(edges))
        edges.append([a, 0, -cost])
    for i, words in enumerate(capacity):
        for r in range(most):
            arc(start, i, words, 2 * r + 1)
        for j in members[i]:
            arc(i, p + j, most * words, 0)
    for j, words in enumerate(quota):
        arc(p + j, end, words, 0)
    potential = [0] * (p + s + 2)
    while True:
        dist, via, heap = {start: 0}, {}, [(0, start)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > dist[a]:
                continue
            for e in out[a]:
                b, room, cost = edges[e]
                new = d + cost + potential[a] - potential[b]
                if room > 0 and new < dist.get(b, new + 1):
                    dist[b], via[b] = new, e
                    heapq.heappush(heap, (new, b))
        if end not in dist:
            break
        for node in range(p + s + 2):
            potential[node] += min(dist.get(node, dist[end]), dist[end])
        path, node = [], end
        while node != start:
            path.append(via[node])
            node = edges[via[node] ^ 1][0]
        words = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= words
            edges[e ^ 1][1] += words
    routes = {}
    for i in range(p):
        for e in out[i]:
            b = edges[e][0]
            if e % 2 == 0 and p <= b < p + s and edges[e ^ 1][1]:
                routes[i, b - p] = edges[e ^ 1][1]
    return routes


def routed(patterns: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """(pattern, source key, words) of the flow.  Sources that share no pattern, even over others, are apart: each connected
    group of sources is solved by itself, from sums per pattern."""
    many = patterns.filter(F.size("members") > 1).select(F.element_at("members", 1).alias("a"), F.explode("members").alias("b"))
    group = components(many, "mix_groups")
    parts = patterns.withColumn("first", F.element_at("members", 1)).join(group.select(F.col("id").alias("first"), "component"), "first", "left").select(
        F.coalesce("component", "first").alias("group"), "members", F.col("words").alias("amount"))
    wants = targets.join(group.select(F.col("id").alias("key"), "component"), "key", "left").select(
        F.coalesce("component", "key").alias("group"), F.array("key").alias("members"), F.floor("target").alias("amount"))

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        want, have = rows[rows["quota"]], rows[~rows["quota"]]
        names = sorted(m[0] for m in want["members"])
        at = {n: i for i, n in enumerate(names)}
        quota = [0] * len(names)
        for m, amount in zip(want["members"], want["amount"]):
            quota[at[m[0]]] = int(amount)
        have = have.assign(name=["\n".join(m) for m in have["members"]]).sort_values("name")
        members = [list(m) for m in have["members"]]
        got = min_cost_routes([int(a) for a in have["amount"]], [[at[n] for n in m if n in at] for m in members], quota, most)
        return pd.DataFrame([(members[i], names[j], words) for (i, j), words in sorted(got.items())], columns=["members", "key", "words"], dtype=object)
    both = parts.withColumn("quota", F.lit(False)).unionByName(wants.withColumn("quota", F.lit(True)))
    return both.groupBy("group").applyInPandas(solve, "members array<string>, key string, words long")


# ------------------------------------------------------------------ selection
def source_key(source: Column) -> Column:
    """A non-null name of a source that sorts as the source does."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("m"), source.cast("string")))


def mix(docs: DataFrame, targets: DataFrame, most: int = MOST_COPIES, seed: int = SEED, most_sent: int = MOST_SENT) -> DataFrame:
    """How often each document is taken, and for which source: rows of docs with copies and taken (words, repeats counted).

    docs(doc_id, members array of source keys, size, hash): hash is a seeded hash of the row's content; targets(key, target).
    A document of several sources can serve any of them.  Words flow from membership patterns to targets at the
    least cost of repetition; a pattern's documents lie in the order of their hashes on a tape, once per pass, and each
    route takes the documents that lie wholly in its stretch.  What is left of a target, less than one document
    of the tape, is filled in rounds from further documents, largest first.  Reruns give the same rows.  Documents
    without words, or without members, are not taken.
    """
    ship(docs.sparkSession)
    docs = docs.withColumn("members", F.array_sort(F.array_distinct(F.coalesce("members", F.array().cast("array<string>")))))
    bucket = F.pmod("hash", F.lit(BUCKETS)).cast("int")
    in_bucket = Window.partitionBy("members", "bucket").orderBy("hash", "doc_id", "size")
    placed = materialize(docs.withColumn("bucket", bucket).withColumn("pos", F.row_number().over(in_bucket)).withColumn(
        "inner", F.sum("size").over(in_bucket.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")), "mix_placed")
    sums = materialize(placed.filter(F.size("members") > 0).groupBy("members", "bucket").agg(F.sum("size").alias("words")), "mix_sums")
    patterns = sums.groupBy("members").agg(F.sum("words").alias("words")).filter("words > 0")
    tape = Window.partitionBy("members").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    flow = routed(patterns, targets, most).withColumn("from", F.coalesce(F.sum("words").over(tape), F.lit(0).cast("long")))
    stretches = flow.groupBy("members").agg(F.array_sort(F.collect_list(F.struct(  # at most one entry per member
        F.col("from"), (F.col("from") + F.col("words")).alias("to"), "key"))).alias("routes"))
    before = F.sum("words").over(Window.partitionBy("members").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    starts = sums.select("members", "bucket", before.alias("outer")).join(
        patterns.join(stretches, "members", "left").select("members", F.col("words").alias("pass"), "routes"), "members")
    # only buckets join to documents, so a hot pattern is dealt by its buckets
    on_tape = placed.join(starts, ["members", "bucket"], "left")
    at = F.col("inner") + F.col("outer")
    passes = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda j: at + j * F.col("pass"))
    served = F.filter(F.transform(F.coalesce("routes", F.array().cast("array<struct<from:bigint,to:bigint,key:string>>")), lambda r: F.struct(
        r["key"].alias("key"), F.size(F.filter(passes, lambda x: (x >= r["from"]) & (x + F.col("size") <= r["to"]))).alias("n"))), lambda r: r["n"] > 0)
    taken = materialize(on_tape.select("doc_id", "members", "bucket", "pos", "hash", "size", F.when(F.col("size") > 0, served).alias("served"))
                        .withColumn("copies", F.coalesce(F.aggregate("served", F.lit(0), lambda a, r: a + r["n"]), F.lit(0))), "mix_taken")

    served_words = taken.filter("copies > 0").select("size", F.explode("served").alias("r")).groupBy(F.col("r.key").alias("key")).agg(F.sum(F.col("size") * F.col("r.n")).alias("words"))
    given = materialize(served_words, "mix_given")
    place = ["members", "bucket", "pos"]
    extra = None
    while True:
        now = given if extra is None else given.unionByName(extra.groupBy("key").agg(F.sum("size").alias("words")))
        gaps = materialize(targets.join(now.groupBy("key").agg(F.sum("words").alias("words")), "key", "left").select(
            "key", "target", (F.floor("target") - F.coalesce("words", F.lit(0))).alias("gap")).filter(F.col("gap") > NEAR * F.col("target")), "mix_gaps")
        open_gaps = gaps.count()
        if not open_gaps:
            break
        free = taken if extra is None else taken.join(extra.groupBy(*place).agg(F.count("*").alias("more")), place, "left").withColumn(
            "copies", F.col("copies") + F.coalesce("more", F.lit(0)))
        new = materialize(fillers(free.filter((F.col("copies") < most) & (F.col("size") > 0) & (F.size("members") > 0)), gaps, open_gaps <= most_sent // SLICES), "mix_extra")
        if new.isEmpty():
            break
        extra = new if extra is None else extra.unionByName(new)
    if extra is not None:
        taken = taken.join(extra.groupBy(*place).agg(F.count("*").alias("more")), place, "left").withColumn("copies", (F.col("copies") + F.coalesce("more", F.lit(0))).cast("int"))
    return taken.select("doc_id", "members", "hash", "size", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def fillers(free: DataFrame, gaps: DataFrame, send: bool) -> DataFrame:
    """Documents for what is left of each target, (members, bucket, pos, key, size): of PER_CLASS candidates per size class,
    largest first, each that still fits.  A document of several sources fills the one that its hash picks.

    Candidates are ranked in slices of a source first, and every slice meets its own row of the gap: a join on the source
    alone would deal a hot source to one task and leave its slices there.  `send` broadcasts the gaps.
    """
    per_class = Window.partitionBy("key", "class").orderBy("copies", "hash", "pos")
    in_slice = Window.partitionBy("key", "class", "slice").orderBy("copies", "hash", "pos")
    sliced = gaps.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    owner = F.element_at("members", (F.pmod(F.shiftright("hash", 16), F.size("members")) + 1).cast("int"))
    few = free.select("members", "bucket", "pos", "hash", "size", "copies", owner.alias("key"), (F.col("bucket") % SLICES).alias("slice")).join(
        F.broadcast(sliced) if send else sliced, ["key", "slice"]).filter("size <= gap").withColumn(
        "class", F.floor(F.log2("size"))).withColumn("n", F.row_number().over(in_slice)).filter(F.col("n") <= PER_CLASS).withColumn(
        "n", F.row_number().over(per_class)).filter(F.col("n") <= PER_CLASS)
    item = F.struct((-F.col("size")).alias("minus"), "copies", "hash", "pos", "bucket", "members")
    fills = few.groupBy("key", "gap").agg(F.array_sort(F.collect_list(item)).alias("items"))  # PER_CLASS per size class
    none = F.array().cast("array<struct<members:array<string>,bucket:int,pos:int,size:bigint>>")
    chosen = F.aggregate("items", F.struct(F.col("gap").alias("left"), none.alias("picked")), lambda acc, x: F.when(
        -x["minus"] <= acc["left"], F.struct((acc["left"] + x["minus"]).alias("left"), F.concat(acc["picked"], F.array(F.struct(
            x["members"].alias("members"), x["bucket"].alias("bucket"), x["pos"].alias("pos"), (-x["minus"]).alias("size")))).alias("picked"))).otherwise(acc))["picked"]
    return fills.select("key", F.explode(chosen).alias("c")).select("c.*", "key")


def mix_by_source(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The mix of docs(doc_id, text, source), each in one source, and the sources with size and target."""
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), content_hash(seed).alias("hash"))
    rows = materialize(rows, "mix_docs")
    sources = rows.groupBy("source").agg(F.sum("size").alias("size"))
    targets = materialize(weighted_targets(sources, weights, most).withColumn("key", source_key(F.col("source"))), "mix_targets")
    mixed = mix(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.array(source_key(F.col("source"))).alias("members"), "size", "hash"), targets, most, seed)
    return mixed, targets


def content_hash(seed: int) -> Column:
    return F.xxhash64("doc_id", "source", "text", F.lit(seed))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED, most_sent: int = MOST_SENT) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of docs(doc_id, text, source, ...), whatever
    their names.  Documents without words (null or empty texts) are not taken; rows that repeat wholly share their copies.

    Nearly all documents of a hash bucket of a source are taken equally often: the mix cuts a source's tape at few
    places.  Such buckets go out as a table of (source, bucket, copies), and their texts do not move; the documents of
    the other buckets are joined by their hash.  Up to `most_sent` buckets the table is broadcast, beyond it is joined.
    """
    mixed, _ = mix_by_source(docs, weights, most, seed)
    mixed = materialize(mixed.select("doc_id", F.element_at("members", 1).alias("source"), F.pmod("hash", F.lit(BUCKETS)).cast("int").alias("bucket"), "hash", "copies"), "mix_copies")
    buckets = materialize(mixed.groupBy("source", "bucket").agg(F.min("copies").alias("least"), F.max("copies").alias("most")), "mix_buckets")
    sent = F.broadcast(buckets) if buckets.count() <= most_sent else buckets
    rows = packed(docs, id=F.col("doc_id").cast("long"), hash=content_hash(seed), source=source_key(F.col("source"))).withColumn("bucket", F.pmod("hash", F.lit(BUCKETS)).cast("int"))
    rows = rows.join(sent, ["source", "bucket"])
    alike = rows.filter("least = most").select("row", F.col("least").alias("share"))
    often = mixed.join(buckets.filter("least < most").select("source", "bucket"), ["source", "bucket"], "left_semi").groupBy(F.col("doc_id").alias("of"), F.col("hash").alias("of_hash")).agg(
        F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    cut = rows.filter("least < most").join(often, (F.col("hash") == F.col("of_hash")) & F.col("id").eqNullSafe(F.col("of")))
    nth = F.row_number().over(Window.partitionBy("hash").orderBy("hash"))
    apart = cut.withColumn("nth", nth).select("row", F.floor((F.col("copies") + F.col("rows") - F.col("nth")) / F.col("rows")).cast("int").alias("share"))
    return alike.unionByName(apart).filter("share > 0").select("row", F.explode(F.sequence(F.lit(1), "share")).alias("copy")).select("row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, targets = mix_by_source(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    named = mixed.withColumn("key", F.element_at("members", 1))
    return named.join(targets.select("key", F.col("size").alias("source_size"), "target"), "key").select("doc_id", "size", "source_size", "target", "taken", "copies")
