"""SimHash near-dedup with a generalised pigeonhole: correlated bits grouped into parts, unequal thresholds per
fingerprint by dynamic programming on estimated candidate counts, then probe and verify."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import met
from ..session import materialize, ship
from .common import components, forest, packed, table

BITS = 64
SEED = 42
BUCKET = 2048       # most rows of one side of a bucket, on average, before it is split
LEAST_PARTS = 4     # so a part has at most 16 bits and the table of value counts at most 4 x 65,536 entries
PROBE_COST = 500.0  # comparisons of two fingerprints that cost as much as one more row in a bucket
SMALL = 256         # pairs of a bucket that are compared in one vector operation with other buckets
AT_ONCE = 1 << 15   # shingles hashed at once
SLICE = 512         # texts whose shingles a task holds at once
SHINGLE_WORDS = 5   # of the similarity of texts
BANDS, BAND_ROWS = 64, 7            # a pair of similarity s shares no band with probability (1 - s^7)^64: 3e-7 at 0.8
NEAR_BITS = 3       # at most so many bits apart are the SimHash candidates among texts
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1 << 21  # most texts and shingles of a block, on average


def fingerprint(text: str | None, words: int = 3) -> int:
    """64 bits over word shingles of the text with A-Z lower-cased: a bit is 1 if set in over half of the hashes.

    Words are runs without ASCII white space; a text of fewer words is one shingle; none gives zero.  A long text
    is counted in pieces, so memory follows its words and not its shingles.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    n = max(1, len(parts) - words + 1)
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, AT_ONCE):
        few = parts[at:min(at + AT_ONCE, n) + words - 1]
        joined = zip(*(few[i:] for i in range(words))) if len(parts) >= words else [parts]
        ones += set_bits(np.array([digest(b" ".join(s), SEED) for s in joined], np.uint64))
    return majority(ones, n)


def set_bits(hashes: np.ndarray) -> np.ndarray:
    """In how many of the hashes each bit is set."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def majority(ones: np.ndarray, n: int) -> int:
    return sum(1 << i for i in range(BITS) if 2 * int(ones[i]) > n)


def as_signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, key, fp) per row of docs(doc_id, text): key hashes id and text, fp holds the 64 bits as a signed long."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "key": batch["key"], "fp": np.array([as_signed(fingerprint(t, words)) for t in batch["text"]], np.int64)})
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), F.col("text").cast("string").alias("text")).mapInPandas(
        run, "doc_id long, key long, fp long")


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


# ------------------------------------------------------------------ parts and thresholds
def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for every two bits, how many have both set (a 64 x 64 table)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            for at in range(0, len(batch), 65536):
                bits = _bits(batch["fp"].to_numpy()[at:at + 65536]).astype(np.float32)
                both += (bits.T @ bits).astype(np.int64)
                n += len(bits)
        yield pd.DataFrame({"cell": np.arange(BITS * BITS + 1), "n": np.append(both.ravel(), n)})
    got = fps.select("fp").mapInPandas(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    flat = np.zeros(BITS * BITS + 1, np.int64)
    flat[got["cell"]] = got["n"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlated_parts(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The 64 bits in `parts` groups of nearly equal width; each grows from the bit with the strongest ties by the bit
    most correlated with those it has, so that skew gathers in few parts, which the thresholds then avoid."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    scale = np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-12))
    tie = np.abs(cov / scale)
    np.fill_diagonal(tie, 0)
    free, groups = set(range(BITS)), []
    for i in range(parts):
        width = BITS // parts + (i < BITS % parts)
        left = sorted(free)
        group = [max(left, key=lambda b: (tie[b, left].sum(), -b))]
        free.discard(group[0])
        while len(group) < width:
            best = max(sorted(free), key=lambda b: (tie[b, group].sum(), -b))
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def pick_parts(n: int, most_bits: int) -> int:
    """The number of parts with the least probes plus candidates per fingerprint if bits were independent."""
    def cost(parts: int) -> float:
        total, width = most_bits + 1, BITS / parts  # of thresholds + 1
        share = [sum(comb(round(width), r) for r in range(total // parts + (i < total % parts))) for i in range(parts)]
        return PROBE_COST * sum(share) + sum(s * n / 2 ** width for s in share)
    return min(range(LEAST_PARTS, max(LEAST_PARTS, most_bits + 1) + 1), key=cost)


def project(fps: np.ndarray, group: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.int64)
    for i, b in enumerate(group):
        out |= ((fps >> b) & 1) << i
    return out


def thresholds(counts: np.ndarray, widths: list[int], most_bits: int) -> np.ndarray:
    """Per row the thresholds (-1: part not probed) that sum to most_bits - parts + 1 at the least estimated cost.

    counts[row, part] = (candidates at distance 0, at distance 1); a part's cost at threshold t is its probes plus the
    candidates within t, the outer shells carried on from the first two.  By dynamic programming over the parts.
    """
    rows, parts = counts.shape[:2]
    levels = list(range(-1, most_bits + 1))
    total = most_bits - parts + 1 + parts  # of thresholds + 1
    best = np.full((rows, total + 1), np.inf)
    best[:, 0] = 0
    took = []
    for i in range(parts):
        new, arg = np.full((rows, total + 1), np.inf), np.zeros((rows, total + 1), np.int8)
        zero, one, w = counts[:, i, 0], counts[:, i, 1], widths[i]
        shell, cost = zero.astype(float), np.zeros(rows)
        for t in levels:
            if t >= 0:
                shell = zero if t == 0 else one if t == 1 else shell * (w - t + 1) / t
                cost = cost + shell + PROBE_COST * (comb(w, t) if t else 0.5)  # its own value is listed anyway
            for s in range(t + 1, total + 1):
                value = best[:, s - t - 1] + cost
                better = value < new[:, s]
                new[better, s], arg[better, s] = value[better], t
        best = new
        took.append(arg)
    out, left = np.zeros((rows, parts), np.int8), np.full(rows, total)
    for i in reversed(range(parts)):
        out[:, i] = took[i][np.arange(rows), left]
        left = left - out[:, i] - 1
    return out


def variants(width: int, radius: int) -> np.ndarray:
    """Masks of all changes of up to `radius` of `width` bits."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)], np.int64)


# ------------------------------------------------------------------ probe and verify
LISTED, BOTH, ASKS = 0, 1, 2  # what a row does in its bucket; in the order in which rows are sorted


def compare_buckets(most_bits: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Over rows sorted by bucket: links between the probing and the listed fingerprints of each bucket, as stars."""
    def stars(rows: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        key = rows[["part", "value", "p", "x"]].to_numpy()
        first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
        ends = np.append(first[1:], len(rows))
        fp, rep, kind = rows["fp"].to_numpy(), rows["rep"].to_numpy(), rows["kind"].to_numpy()
        ask = first + np.add.reduceat((kind == LISTED).astype(np.int64), first)  # sorted by kind: those that ask begin here
        listed = np.add.reduceat((kind != ASKS).astype(np.int64), first)
        asking = ends - ask
        a, b = [], []
        few = np.flatnonzero((listed * asking > 0) & (listed * asking <= SMALL) & (ends - first > 1))
        pairs = listed[few] * asking[few]
        for at in range(0, len(few), 8192):  # all pairs of many small buckets together
            g, size = few[at:at + 8192], pairs[at:at + 8192]
            which = np.repeat(g, size)
            within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            i, j = first[which] + within % listed[which], ask[which] + within // listed[which]
            near = (np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)) <= most_bits) & (fp[i] != fp[j])
            a.append(rep[i[near]])
            b.append(rep[j[near]])
        for g in np.flatnonzero(listed * asking > SMALL):
            x, y = slice(first[g], first[g] + listed[g]), slice(ask[g], ends[g])
            linked = np.concatenate([np.bitwise_count((fp[y][i:i + 256, None] ^ fp[x][None, :]).view(np.uint64)) <= most_bits for i in range(0, asking[g], 256)])
            linked &= fp[y][:, None] != fp[x][None, :]
            ids, roots = forest(linked, rep[y], rep[x])
            a.append(ids)
            b.append(roots)
        out = pd.DataFrame({"a": np.concatenate(a) if a else np.empty(0, np.int64), "b": np.concatenate(b) if b else np.empty(0, np.int64)})
        return out[out["a"] != out["b"]].drop_duplicates()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None or not len(held) else pd.concat([held, batch], ignore_index=True)
            key = held[["part", "value", "p", "x"]].to_numpy()
            last = int(np.flatnonzero((key != key[-1]).any(axis=1)).max(initial=-1)) + 1  # where the last bucket, still open, begins
            if last:
                yield stars(held.iloc[:last])
                held = held.iloc[last:].reset_index(drop=True)
        if held is not None:
            yield stars(held)
    return run


def value_counts(fps: DataFrame, groups: list[list[int]]) -> list[np.ndarray]:
    """Per part, how many fingerprints have each value: tables of at most 2^16 numbers, from all fingerprints."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [np.zeros(1 << len(g), np.int64) for g in groups]
        for batch in batches:
            for count, g in zip(held, groups):
                count += np.bincount(project(batch["fp"].to_numpy(), g), minlength=len(count))
        for i, count in enumerate(held):
            at = np.flatnonzero(count)
            yield pd.DataFrame({"part": np.full(len(at), i, np.int32), "value": at, "n": count[at]})
    found = fps.select("fp").mapInPandas(run, "part int, value long, n long").groupBy("part", "value").agg(F.sum("n").alias("n")).toPandas()
    out = [np.zeros(1 << len(g), np.int64) for g in groups]
    for i, count in enumerate(out):
        own = found[found["part"] == i]
        count[own["value"]] = own["n"]
    return out


def bucket_rows(groups: list[list[int]], counts: list[np.ndarray], most_bits: int, bucket: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The rows of each fingerprint: listed under its own value of every part, asking at the values within its thresholds.

    A bucket that more than `bucket` list or may ask is cut into tiles (p, x): who is listed has one x and every p, who
    asks one p and every x.
    """
    widths = [len(g) for g in groups]
    nearby = [sum(c[np.arange(len(c)) ^ (1 << b)] for b in range(w)) for c, w in zip(counts, widths)]
    masks = {(w, r): variants(w, r) for w in set(widths) for r in range(most_bits + 1)}
    tiles_x = [np.maximum(1, -(-c // bucket)) for c in counts]
    tiles_p = [np.maximum(1, -(-(c + n) // bucket)) for c, n in zip(counts, nearby)]

    def frame(part: int, value: np.ndarray, kind: int, fp: np.ndarray, rep: np.ndarray) -> pd.DataFrame:
        xs, ps = tiles_x[part][value], tiles_p[part][value]
        spread = ((fp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
        if kind == BOTH and (xs * ps == 1).all():
            p, x, many = np.zeros(len(fp), np.int32), np.zeros(len(fp), np.int32), np.ones(len(fp), np.int64)
        else:
            many = ps if kind == LISTED else xs
            nth = (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)).astype(np.int32)
            own = np.repeat(spread % (xs if kind == LISTED else ps), many).astype(np.int32)
            p, x = (nth, own) if kind == LISTED else (own, nth)
        return pd.DataFrame({"part": np.full(len(p), part, np.int32), "value": np.repeat(value, many).astype(np.int32), "p": p, "x": x,
                             "kind": np.full(len(p), kind, np.int8), "fp": np.repeat(fp, many), "rep": np.repeat(rep, many)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                fp, rep = batch["fp"].to_numpy()[at:at + 4096], batch["rep"].to_numpy()[at:at + 4096]
                values = [project(fp, g) for g in groups]
                limit = thresholds(np.stack([np.stack([c[v], n[v]], axis=1) for c, n, v in zip(counts, nearby, values)], axis=1).astype(float), widths, most_bits)
                for i, value in enumerate(values):
                    one = (tiles_x[i][value] == 1) & (tiles_p[i][value] == 1)
                    for mine, kind in ((limit[:, i] < 0, LISTED), ((limit[:, i] >= 0) & one, BOTH), ((limit[:, i] >= 0) & ~one, LISTED), ((limit[:, i] >= 0) & ~one, ASKS)):
                        if mine.any():
                            yield frame(i, value[mine], kind, fp[mine], rep[mine])
                    for t in range(1, most_bits + 1):
                        mine, mask = limit[:, i] == t, masks[widths[i], t][1:]
                        if mine.any():
                            asked = (value[mine][:, None] ^ mask[None, :]).ravel()
                            some = counts[i][asked] > 0  # a value that nobody has meets nothing
                            yield frame(i, asked[some], ASKS, np.repeat(fp[mine], len(mask))[some], np.repeat(rep[mine], len(mask))[some])
    return run


def fingerprint_links(fps: DataFrame, most_bits: int = 3, parts: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between the reps of distinct fingerprints fps(fp, rep) that connect all those at most `most_bits`
    apart: every such pair is found in a bucket, and each bucket gives a spanning star of its links.

    Generalised pigeonhole: with thresholds t_i over m parts that sum to most_bits - m + 1, two fingerprints within
    most_bits differ in some part i by at most t_i bits (-1: not probed).  Every fingerprint is listed once per part and
    probes part i with all values within its own t_i.  The counts of all values, by which the thresholds are chosen, are a
    table of bounded size, so the rows are made in one pass and dealt once.  Values that very many share cost much, so
    most fingerprints shift their threshold to other parts; what is left of a hot bucket is cut into tiles.
    """
    ship(fps.sparkSession)
    n, both = bit_counts(fps)
    m = parts or pick_parts(n, most_bits)
    if m < LEAST_PARTS:
        raise ValueError(f"at least {LEAST_PARTS} parts")
    groups = correlated_parts(n, both, m)
    dealt = fps.select("fp", "rep").mapInPandas(
        bucket_rows(groups, value_counts(fps, groups), most_bits, bucket), "part int, value int, p int, x int, kind byte, fp long, rep long")
    return dealt.repartition("part", "value", "p", "x").sortWithinPartitions("part", "value", "p", "x", "kind").mapInPandas(
        compare_buckets(most_bits), "a long, b long")


def simhash_groups(docs: DataFrame, words: int = 3, most_bits: int = 3, parts: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """Per row of docs(doc_id, text): (doc_id, key, fp, component_id), component_id the smallest doc_id reachable by links
    between fingerprints that differ in at most `most_bits` bits, itself included.

    A null or empty text, or one of white space only, has fingerprint zero and links like any other.  Repeated rows
    stay and share a component; a row with a null doc_id has the component of the other rows with its fingerprint, and
    null where there are none.  Whole texts count, however long.  Other columns are ignored.  Equal fingerprints are
    compared once, whatever their number.
    """
    marked = materialize(fingerprints(docs, words), "simhash_docs")
    reps = materialize(marked.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash_reps")
    groups = components(fingerprint_links(reps, most_bits, parts, bucket), "simhash_components")
    named = reps.join(groups.withColumnRenamed("id", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return marked.join(named, "fp", "left").select("doc_id", "key", "fp", "component_id")


# ------------------------------------------------------------------ near copies by shingle similarity
_DRAW = np.random.default_rng(SEED)
_WORD = _DRAW.integers(0, 1 << 63, SHINGLE_WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_TIMES = _DRAW.integers(0, 1 << 31, BANDS * BAND_ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _DRAW.integers(0, 1 << 32, BANDS * BAND_ROWS, np.uint32)
_BAND = _DRAW.integers(0, 1 << 63, (BANDS, BAND_ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted 64-bit hashes of the text's distinct five-word shingles, words as in `fingerprint`; a text of fewer
    words is one shingle, none has no shingle."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    words = np.fromiter((digest(w, SEED) for w in parts), np.uint64, len(parts))
    n = max(1, len(parts) - SHINGLE_WORDS + 1)
    return np.unique(mixed(sum(words[i:i + n] * _WORD[i] for i in range(min(SHINGLE_WORDS, len(parts))))))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One 64-bit key per band over BAND_ROWS min-hashes; texts without shingles have none."""
    if not len(shingles):
        return np.empty(0, np.int64)
    x, least = (shingles >> np.uint64(32)).astype(np.uint32), np.full(BANDS * BAND_ROWS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(least, (_TIMES[:, None] * x[None, at:at + 512] + _PLUS[:, None]).min(axis=1), out=least)
    return mixed((least.reshape(BANDS, BAND_ROWS).astype(np.uint64) * _BAND).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def set_fingerprint(shingles: np.ndarray) -> int | None:
    """The SimHash of a set of shingle hashes, as a signed long; texts without shingles have none."""
    if not len(shingles):
        return None
    return as_signed(majority(sum(set_bits(shingles[at:at + AT_ONCE]) for at in range(0, len(shingles), AT_ONCE)), len(shingles)))


def fingerprint_stars(marked: DataFrame) -> DataFrame:
    """Candidate links (a, b) between nodes of marked(node, fp) whose fingerprints differ in at most NEAR_BITS bits: texts of one
    fingerprint are linked to its smallest node, and those nodes by `fingerprint_links`."""
    own = marked.filter("fp is not null").select("node", "fp")
    reps = materialize(own.groupBy("fp").agg(F.min("node").alias("rep"), F.max("node").alias("last")), "copies_fingerprints")
    same = own.join(reps.filter("rep < last"), "fp").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    return same.unionByName(fingerprint_links(reps.select("fp", "rep"), NEAR_BITS))


def copy_hash(text: str | None) -> int:
    """Equal for texts of the same words; as everywhere 64 bits."""
    return as_signed(xxhash.xxh3_64_intdigest(b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()), SEED))


def similar_texts(docs: DataFrame, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """All rows of docs(doc_id, text) as (doc_id, key, node), and (component, doc_id, key) per group: the first row of each
    group of texts that are linked by equal words or a Jaccard similarity of at least `similarity` of their sets of
    five-word shingles.

    Candidates have SimHash fingerprints of their sets of shingles at most NEAR_BITS bits apart, found by `fingerprint_links`, or,
    as 64 bits miss many pairs near that similarity, share one of BANDS keys over BAND_ROWS min-hashes each.  Both are
    made once per text that a task sees; a bucket leaves a star, so a group of any size makes rows in proportion.  Every pair of a candidate component is then decided on
    the whole sets of shingles; only texts of candidates move for that.
    """
    ship(docs.sparkSession)

    def marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, len(batch), SLICE):  # few texts at a time: their sets of shingles are larger than they
                part = batch.iloc[at:at + SLICE]
                nodes, sizes, bands = np.array([copy_hash(t) for t in part["text"]], np.int64), np.zeros(len(part), np.int64), [None] * len(part)
                fps = [None] * len(part)
                for i, (node, text) in enumerate(zip(nodes.tolist(), part["text"])):
                    if node not in seen:
                        seen.add(node)
                        shingles = shingle_set(text)
                        sizes[i], bands[i], fps[i] = len(shingles), band_keys(shingles), set_fingerprint(shingles)
                if len(seen) > AT_ONCE:  # copies lie near each other or are few: enough to remember some
                    seen.clear()
                yield pd.DataFrame({"doc_id": part["doc_id"], "key": part["key"], "node": nodes, "n": sizes, "bands": bands, "fp": pd.array(fps, "Int64")})
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), F.col("text").cast("string").alias("text"))
    marked = materialize(keyed.mapInPandas(marks, "doc_id long, key long, node long, n long, bands array<long>, fp long"), "copies_marked")
    banded = marked.select("node", F.explode("bands").alias("band"))
    lows = materialize(banded.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("band", "low"), "copies_buckets")
    shared = met(banded, "band", lows.select("band")).filter("met").select("node", "band")
    banded_stars = shared.join(lows, "band").select(F.col("node").alias("a"), F.col("low").alias("b"))
    stars = components(fingerprint_stars(marked).unionByName(banded_stars), "copies_met")
    nodes = materialize(marked.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key")).alias("first"), F.max("n").alias("n")), "copies_nodes")
    members = materialize(stars.withColumnRenamed("id", "node").join(nodes, "node").select("node", "component", F.col("first.key").alias("key"), "n"), "copies_members")
    texts = met(keyed.select("key", "text"), "key", members.select("key")).filter("met").select("key", "text")
    groups = components(similar_links(members, texts, similarity), "copies_similar")
    return marked.select("doc_id", "key", "node"), nodes.join(groups.withColumnRenamed("id", "node"), "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(
        F.min("first").alias("first")).select("component", "first.doc_id", "first.key")


def similar_links(members: DataFrame, texts: DataFrame, similarity: float, block: int = BLOCK_ROWS) -> DataFrame:
    """Links (a, b) that connect those of members(node, component, key, n) which share a component and whose sets of
    shingles, of texts(key, text), have at least that Jaccard similarity.

    A component is cut into blocks of bounded size; each pair of blocks is compared by one task and leaves spanning stars.
    """
    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.iloc[at:at + SLICE]
                yield pd.DataFrame({"node": part["node"], "component": part["component"], "shingles": [shingle_set(t).tobytes() for t in part["text"]]})
    sizes = members.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    near = materialize(texts.join(members, "key").dropDuplicates(["key"]).select("node", "component", "text").mapInPandas(
        hashed, "node long, component long, shingles binary"), "copies_near")
    paired = (near.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("component", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "node", "shingles"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in by_key(batches, ["component", "one", "two"]):
            own, node = some["own"].to_numpy(), some["node"].to_numpy()
            left, right = np.flatnonzero(own == some["one"].iat[0]), np.flatnonzero(own == some["two"].iat[0])
            if len(some) > 1 and len(left) and len(right):
                sets = [np.frombuffer(s, np.uint64) for s in some["shingles"]]
                linked = jaccard_links([sets[i] for i in left], [sets[i] for i in right], similarity) & (node[left][:, None] != node[right][None, :])
                a, b = forest(linked, node[left], node[right])
                if len(a):
                    yield pd.DataFrame({"a": a, "b": b})
    return paired.repartition("component", "one", "two").sortWithinPartitions("component", "one", "two").mapInPandas(run, "a long, b long")


def jaccard_links(left: list[np.ndarray], right: list[np.ndarray], similarity: float, columns: int = 4096) -> np.ndarray:
    """Which of left x right have at least that similarity, exactly: products of 0/1 tables over the shingles on both sides."""
    sizes = [np.array([len(s) for s in side]) for side in (left, right)]
    flat = [np.concatenate(side) for side in (left, right)]
    both = np.intersect1d(*(np.unique(x) for x in flat), assume_unique=True)
    where = []
    for x, n in zip(flat, sizes):
        at = np.searchsorted(both, x)
        hit = at < len(both)
        hit[hit] = both[at[hit]] == x[hit]
        row, at = np.repeat(np.arange(len(n)), n)[hit], at[hit]
        order = np.argsort(at, kind="stable")
        where.append((row[order], at[order]))
    common = np.zeros((len(left), len(right)), np.float64)
    for start in range(0, len(both), columns):
        tables = []
        for (row, at), n in zip(where, sizes):
            few = slice(*np.searchsorted(at, [start, start + columns]))
            one = np.zeros((len(n), min(columns, len(both) - start)), np.float32)
            one[row[few], at[few] - start] = 1
            tables.append(one)
        common += tables[0] @ tables[1].T
    return (common >= similarity * (sizes[0][:, None] + sizes[1][None, :] - common)) & (common > 0)


def by_key(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[pd.DataFrame]:
    """The runs of equal keys of sorted rows, each as one frame."""
    held = None
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(held):
            continue
        key = held[columns].to_numpy()
        ends = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        for start, end in zip(np.append(0, ends[:-1]), ends) if len(ends) else ():
            yield held.iloc[start:end]
        if len(ends):
            held = held.iloc[ends[-1]:].reset_index(drop=True)
    if held is not None and len(held):
        yield held


def deduplicated(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """docs without near copies: of each group of `similar_texts` the row with the smallest doc_id stays (then the smallest
    key), with all columns, whatever their names.  A row with a null doc_id stays only if its group has no other; a null
    text is a text without words, like an empty one; rows that repeat wholly are one.

    Rows that stay do not move: those whose key is certainly not among the keys that go or repeat are taken as they are.
    """
    marked, firsts = similar_texts(docs, similarity)
    stays = firsts.select("key", F.lit(True).alias("stays"))
    judged = marked.groupBy("key").agg(F.count("*").alias("n")).join(stays, "key", "left")
    odd = materialize(judged.filter((F.col("n") > 1) | F.col("stays").isNull()).select("key", F.coalesce("stays", F.lit(False)).alias("stays")), "copies_odd")
    rows = met(packed(docs, key=row_key()), "key", odd.select("key"))
    checked = rows.filter("met").join(odd, "key", "left").filter(F.coalesce("stays", F.lit(True)))
    known = F.row_number().over(Window.partitionBy("key").orderBy("key"))  # a key that is not odd comes once anyway
    return rows.filter("not met").select("row.*").unionByName(checked.withColumn("nth", known).filter("nth = 1").select("row.*"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
