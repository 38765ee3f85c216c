"""SimHash near-duplicates with pigeonring candidates.

Fingerprints of 64 bits lie on a ring of M segments.  If two differ in at most MOST bits, then by the pigeonring
principle some start i exists from which every run of l consecutive segments, l = 1..M, differs in at most l * MOST / M
bits.  Runs whose budget is below one bit must agree exactly: they are the key of an equi-join, one key for each start.
Inside a key the budgets of the longer runs are tested before the full Hamming distance.

Documents with one fingerprint are one row from the beginning.  A key shared by more than CROWD distinct fingerprints is
not joined with itself: its fingerprints are dealt to the points at distance one or less from them (two fingerprints
within two bits have a common one), and every fingerprint at a point links to the smallest there.  That is exact, and its
rows grow with the number of fingerprints, not of pairs.

Similar texts (`keep_similar`).  Texts whose sets of five-word shingles have a Jaccard coefficient of 0.8 differ in some
15 of 100 bits, which no 64-bit print can look up, and keys short enough to be equal by then are shared by chance: their
pairs grow with the square of the number of texts.  So candidates share a key of KEY_MINIMA smallest hashes of shingles
under as many permutations, one of KEYS choices among MINIMA.  A text has KEYS keys whatever other texts there are, and
unrelated texts share none.  A pair at 0.8 shares one with a probability of 0.9 or more (see the tests), nearer ones more.
Candidates within the budget of a print of WORDS independent words of 64 bits are held against each other by their exact
coefficient.

In a key that more than SIMILAR_CROWD sets of shingles share, texts are first held against the one that stands in the largest
crowds, LEADERS times: of copies that were edited one by one that is the text they come from, or near it.  Those that are
verified to be similar to one leader are connected, so they are not compared with each other again, but with the rest of
the key.  So the size of a key changes the way and not the groups.  What is left to compare are texts of a crowd that are
similar to no leader, with those that share one of their keys.

Defined results: a null, empty or blank text has fingerprint zero, linked like any other; fewer words than SHINGLE make
one shingle; equal rows have equal fingerprints and so one component; an id that occurs twice stays twice; other columns
are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.llm.bytes_np import LOWER_TABLE, mixed
from granary.llm.common import written

SHINGLE = 3
SEED = 42
MOST = 2
SEGMENTS = 9
#: Distinct fingerprints of a key up to which they are compared in pairs.
CROWD = 32

#: Setting of keep_similar: words in a shingle, least Jaccard coefficient, words of a print.
SIMILAR_SHINGLE = 5
LEAST_SIMILARITY = 0.8
WORDS = 8
#: Smallest hashes that a text is known by, keys made from them, hashes that make a key.
MINIMA = 256
KEYS = 144
KEY_MINIMA = 16
#: Sets of shingles of a key up to which they are compared in pairs.
SIMILAR_CROWD = 8
#: Segments of a word of a print; two of them are a key where there are prints alone.
SIMILAR_SEGMENTS = 7
#: Rounds in which crowded keys follow a leader.
LEADERS = 3
#: Standard deviations that a candidate's difference may exceed the expected one of the least similarity.
SLACK = 2.0

# permutations of 32 bits (odd factors and offsets), the minima of each key, and what makes one number of them
_FACTORS = (mixed(np.arange(1, MINIMA + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_OFFSETS = mixed(np.arange(1, MINIMA + 1, dtype=np.uint64)).astype(np.uint32)
# every minimum stands in equally many keys
_CHOICE = np.argsort(mixed(np.arange(1, KEYS * KEY_MINIMA + 1, dtype=np.uint64) << np.uint64(20)).reshape(-1, MINIMA), axis=1).reshape(KEYS, KEY_MINIMA)
_SCALES = mixed(np.arange(1, KEY_MINIMA + 1, dtype=np.uint64) << np.uint64(40)) | np.uint64(1)

_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle of a text, repeats included; none for a text without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_TABLE).split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    cut = map(slice, begins[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, map(line.__getitem__, cut), repeat(SEED))), ">u8").astype(np.uint64)


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return 0
    # how often each bit is set, from how often each byte value occurs at each of the eight places
    at = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(at[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(sum(1 << int(b) for b in np.flatnonzero(2 * ones > len(hashes))))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (64 bits as a signed long) of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint_of(x.as_py(), shingle) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _cuts(segments: int) -> list[int]:
    return [round(64 * i / segments) for i in range(segments + 1)]


def _segment(fp: Column, i: int, segments: int) -> Column:
    cuts = _cuts(segments)
    i %= segments
    width = cuts[i + 1] - cuts[i]
    return F.shiftrightunsigned(fp, cuts[i]).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def exact_run(most: int, segments: int) -> int:
    """Length of the run whose budget is below one bit."""
    return max(1, -(-segments // most) - 1) if most else segments


def _keys(fps: DataFrame, most: int, segments: int) -> DataFrame:
    """start, key, fp: one row for each start of the ring."""
    run = exact_run(most, segments)
    cuts = _cuts(segments)
    keys = []
    for i in range(segments):
        key, at = F.lit(0).cast("long"), 0
        for j in range(i, i + run):
            key = key.bitwiseOR(F.shiftleft(_segment(F.col("fp"), j, segments), at))
            at += cuts[j % segments + 1] - cuts[j % segments]
        keys.append(F.struct(F.lit(i).alias("start"), key.alias("key")))
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.start", "k.key", "fp")


def within_budgets(start: int, difference: Column, most: int, segments: int) -> Column:
    """Whether the runs from start keep their budgets; difference: fp of one side XOR fp of the other."""
    ok, total = F.lit(True), F.lit(0)
    for length in range(1, segments + 1):
        total = total + F.bit_count(_segment(difference, start + length - 1, segments))
        if length > exact_run(most, segments):
            ok = ok & (total * segments <= length * most)
    return ok


def links(fps: DataFrame, most: int = MOST, segments: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """(a, b), a < b: edges between distinct fingerprints at most `most` bits apart, enough to connect all such.

    fps: distinct fp.  Small keys give every pair; crowded ones link each fingerprint to the smallest at a common point.
    """
    if most != 2:
        raise ValueError("crowded keys are resolved by common points, which are exact for two bits")
    keyed = _keys(fps, most, segments)
    sizes = keyed.groupBy("start", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(keyed.join(sizes, ["start", "key"]), "simhash-keys")
    few, many = shared.where(F.col("n") <= crowd), shared.where(F.col("n") > crowd).select("fp").distinct()
    other = few.select("start", "key", F.col("fp").alias("b"))
    difference = F.col("fp").bitwiseXOR(F.col("b"))
    chained = F.lit(False)
    for i in range(segments):
        chained = chained | ((F.col("start") == i) & within_budgets(i, difference, most, segments))
    pairs = few.join(other, ["start", "key"]).where((F.col("fp") < F.col("b")) & chained & (F.bit_count(difference) <= most)).select(F.col("fp").alias("a"), "b")
    points = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long")) for i in range(64)])
    stars = written(many.select("fp", F.explode(points).alias("point")), "simhash-points")
    middle = stars.groupBy("point").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    crowded = stars.join(middle, "point").where(F.col("fp") > F.col("a")).select("a", F.col("fp").alias("b"))
    return pairs.unionByName(crowded).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 40) -> DataFrame:
    """(node, root): the smallest node reachable from each node of an undirected edge list.

    Large-star and small-star rounds: every node hands its neighbours to the smallest among them, so a chain shortens by
    a power in each round.  Each round is written to the shared folder.  No task gathers a node's neighbours.
    """
    both = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    both = written(both, "components")
    previous = None
    for _ in range(most_rounds):
        # large star: larger neighbours of u go to the smallest neighbour of u (or u itself)
        ways = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = ways.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = ways.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours of u, and u, go to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        both = written(small, "components")
        state = both.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == previous:
            break
        previous = state
    else:
        raise RuntimeError("components did not settle")
    return both.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, most: int = MOST, segments: int = SEGMENTS) -> DataFrame:
    """doc_id, fp and component_id (smallest id that links of fingerprints reach) of every row of docs (doc_id, text)."""
    prints = written(fingerprints(docs, shingle), "simhash-prints")
    # one row for each fingerprint, with its smallest document: a group of copies of any size is one row from here on
    groups = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    groups = written(groups, "simhash-groups")
    roots = components(links(groups.select("fp"), most, segments))
    rooted = groups.join(roots, groups["fp"] == roots["node"], "left").select("fp", "first_id", "n", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.sum("n").alias("size"))
    # a document alone in its component is its own label; the others are looked up, a crowd's label once for each salt
    salts = 16
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    labels = rooted.join(smallest.where("size > 1"), "root").select(F.col("fp").alias("_fp"), "component_id", salt)
    dealt = prints.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    found = dealt.join(labels, (F.col("fp") == F.col("_fp")) & (F.col("salt") == F.col("_salt")), "left")
    return found.select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs without those whose id is not the smallest of its component; a row without an id stays."""
    spare = near_duplicates(docs, shingle).where("doc_id <> component_id").select(F.col("doc_id").alias("_spare_id")).distinct()
    return docs.join(spare, docs["doc_id"] == spare["_spare_id"], "left_anti")


# ------------------------------------------------------------------ similar texts

def budget(similarity: float, bits: int, slack: float = SLACK) -> int:
    """Bits that prints of two equally large sets of shingles with this Jaccard coefficient may differ in."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * p + slack * math.sqrt(bits * p * (1 - p)))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The smallest of a set of hashes under each of MINIMA permutations; two sets agree in one with their coefficient."""
    out = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(high), 1 << 12):
        out = np.minimum(out, (high[i : i + (1 << 12)] * _FACTORS[:, None] + _OFFSETS[:, None]).min(axis=1))
    return out


def keys_of(found: np.ndarray) -> np.ndarray:
    """The KEYS keys of each row of minima, as longs."""
    line = np.zeros((len(found), KEYS), np.uint64)
    for r in range(KEY_MINIMA):
        line += found[:, _CHOICE[:, r]] * _SCALES[r]
    return mixed(line + mixed(np.arange(1, KEYS + 1, dtype=np.uint64))).view(np.int64)


def wide_print(text: str | None, shingle: int = SIMILAR_SHINGLE, words: int = WORDS) -> tuple[int, np.ndarray, np.ndarray]:
    """A hash of the set of a text's shingles, its print of so many words, and its minima."""
    found = shingle_hashes(text, shingle)
    found.sort()
    found = found[np.concatenate([[True], found[1:] != found[:-1]])[: len(found)]]
    own = xxhash.xxh64_intdigest(found.tobytes())
    if not len(found):
        return own, np.zeros(words, np.uint64), minima(found)
    ones = np.zeros((8 * words, 256), np.float32)
    offset = np.arange(8 * words) << 8
    steps = np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(0, len(found), 1 << 14):
        at = mixed(found[i : i + (1 << 14), None] + steps).copy().view(np.uint8).reshape(-1, 8 * words)
        ones += np.bincount((at + offset).ravel(), minlength=len(offset) << 8).reshape(-1, 256)
    bits = 2 * (ones @ _BITS.astype(np.float32)).ravel() > len(found)
    return own, np.packbits(bits, bitorder="little").view(np.uint64), minima(found)


def _wide_prints(docs: DataFrame, shingle: int, words: int) -> DataFrame:
    """row, doc_id, kind (which set of shingles), the words w0, w1, .. of every row's print, and its minima."""
    names = [f"w{k}" for k in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [wide_print(x.as_py(), shingle, words) for x in batch.column(2)]
            kind = np.array([k for k, _, _ in found], np.uint64).view(np.int64)
            line = np.array([w for _, w, _ in found], np.uint64).reshape(-1, words).view(np.int64)
            least = pa.array([m.tobytes() for _, _, m in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kind), *(pa.array(np.ascontiguousarray(line[:, k])) for k in range(words)), least], ["row", "doc_id", "kind", *names, "minima"])

    return docs.select(_row().alias("row"), "doc_id", "text").mapInArrow(run, "row long, doc_id long, kind long, " + ", ".join(f"{n} long" for n in names) + ", minima binary")


def _minima_keys(kinds: DataFrame) -> DataFrame:
    """key, kind: KEYS rows for each row of kinds (kind, minima)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                found = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, MINIMA)
                kind = np.repeat(batch.column(0).to_numpy(), KEYS)
                yield pa.RecordBatch.from_arrays([pa.array(keys_of(found).ravel()), pa.array(kind)], ["key", "kind"])

    return kinds.select("kind", "minima").mapInArrow(run, "key long, kind long")


def _row() -> Column:
    """What tells rows apart: their id and text."""
    return F.xxhash64("doc_id", "text")


def _ring_keys(prints: DataFrame, words: int) -> DataFrame:
    """key, kind: for each start on the ring of each word the two segments there, of some 18 bits."""
    segments, cuts = SIMILAR_SEGMENTS, _cuts(SIMILAR_SEGMENTS)
    keys = []
    for k in range(words):
        for i in range(segments):
            second = F.shiftleft(_segment(F.col(f"w{k}"), i + 1, segments), cuts[i + 1] - cuts[i])
            keys.append(_segment(F.col(f"w{k}"), i, segments).bitwiseOR(second).bitwiseOR(F.lit((k * segments + i) << 32)))
    return prints.select(F.explode(F.array(*keys)).alias("key"), "kind")


def similar_pairs(
    prints: DataFrame, verified: Callable[[DataFrame], DataFrame], words: int = WORDS, similarity: float = LEAST_SIMILARITY, crowd: int = SIMILAR_CROWD, *, keyed: DataFrame | None = None
) -> DataFrame:
    """(a, b), a < b: links between kinds, enough to connect all verified ones that share a key and whose prints are near.

    prints: distinct kind with words; verified: of pairs (a, b) those that are links; keyed: key, kind, without it the
    segments of the prints.  Whether two kinds are held against each other depends on their keys and prints alone.  crowd
    decides how a key's pairs are gone through, not which are connected: two kinds are only left apart if both are
    verified links of one leader.
    """
    in_all = budget(similarity, 64 * words)
    keyed = _ring_keys(prints, words) if keyed is None else keyed
    counted = keyed.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("key")))
    shared = written(counted.where("n > 1"), "similar-keys")
    rest, crowded = shared.where(F.col("n") <= crowd).drop("n"), shared.where(F.col("n") > crowd)
    other = rest.select("key", F.col("kind").alias("b"))
    pairs = rest.join(other, "key").where(F.col("kind") < F.col("b")).select(F.col("kind").alias("a"), "b")
    found = None
    # the weight of a kind is the size of its crowds: the middle of a group of near copies stands in all the large ones
    weights = crowded.groupBy("kind").agg(F.sum("n").alias("weight"))
    crowded = written(crowded.drop("n").join(weights, "kind"), "similar-crowds")
    alone = crowded
    for _ in range(LEADERS):
        if not alone.take(1):
            break
        led = alone.groupBy("key").agg(F.max(F.struct("weight", "kind"))["kind"].alias("a"))
        tried = alone.join(led, "key").where("kind <> a")
        near = written(verified(_near(tried.select("a", F.col("kind").alias("b")).distinct(), prints, words, in_all)), "similar-led")
        found = near if found is None else found.unionByName(near)
        alone = written(tried.drop("a").join(near.select(F.col("b").alias("_gone")).distinct(), F.col("kind") == F.col("_gone"), "left_anti"), "similar-crowds")
    if found is not None:
        # all of a key but its largest group of one leader is compared with the whole key
        leaders = found.select(F.col("a").alias("_led"), F.col("a").alias("kind")).unionByName(found.select(F.col("b").alias("_led"), F.col("a").alias("kind")))
        leaders = leaders.join(weights, "kind").groupBy("_led").agg(F.max(F.struct("weight", "kind"))["kind"].alias("_leader"))
        grouped = written(crowded.join(leaders, F.col("kind") == F.col("_led"), "left").select("key", "kind", F.coalesce("_leader", "kind").alias("group")), "similar-groups")
        counted = grouped.groupBy("key", "group").agg(F.count(F.lit(1)).alias("n"))
        largest = counted.groupBy("key").agg(F.max_by("group", F.struct("n", "group")).alias("main"))
        grouped = grouped.join(largest, "key")
        whole = grouped.select("key", F.col("kind").alias("_kind"), F.col("group").alias("_group"), (F.col("group") == F.col("main")).alias("_main"))
        apart = (F.col("group") != F.col("_group")) & (F.col("_main") | (F.col("kind") < F.col("_kind")))
        across = grouped.where("group <> main").join(whole, "key").where(apart)
        pairs = pairs.unionByName(across.select(F.least("kind", "_kind").alias("a"), F.greatest("kind", "_kind").alias("b")))
        found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = verified(_near(pairs.distinct(), prints, words, in_all))
    return pairs if found is None else pairs.unionByName(found).distinct()


def _near(pairs: DataFrame, prints: DataFrame, words: int, most: int) -> DataFrame:
    """The pairs (a, b) whose prints differ in at most `most` bits of all words together."""
    one = prints.select(F.col("kind").alias("_a"), *[F.col(f"w{k}").alias(f"_a{k}") for k in range(words)])
    two = prints.select(F.col("kind").alias("_b"), *[F.col(f"w{k}").alias(f"_b{k}") for k in range(words)])
    joined = pairs.join(one, F.col("a") == F.col("_a")).join(two, F.col("b") == F.col("_b"))
    bits = sum((F.bit_count(F.col(f"_a{k}").bitwiseXOR(F.col(f"_b{k}"))) for k in range(words)), F.lit(0))
    return joined.where(bits <= most).select("a", "b")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets as sorted arrays; two empty sets are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts (kind, text) have the least similarity, by their exact sets of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list = [None, None]
        for batch in batches:
            keep = []
            for a, one, two in zip(batch.column("a").to_pylist(), batch.column("_one"), batch.column("_two"), strict=True):
                if last[0] != a:
                    last = [a, np.unique(shingle_hashes(one.as_py(), shingle))]
                keep.append(jaccard(last[1], np.unique(shingle_hashes(two.as_py(), shingle))) >= similarity)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in (batch.column("a"), batch.column("b"))], ["a", "b"])

    used = written(texts.join(pairs.select(F.explode(F.array("a", "b")).alias("_used")).distinct(), F.col("kind") == F.col("_used"), "left_semi"), "similar-texts")
    # a leader of many is dealt with a salt
    salts = F.explode(F.sequence(F.lit(0), F.lit(15))).alias("_salt")
    one = used.select(F.col("kind").alias("_a"), F.col("text").alias("_one"), salts)
    two = used.select(F.col("kind").alias("_b"), F.col("text").alias("_two"))
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(16)).cast("int"))
    joined = dealt.join(two, F.col("b") == F.col("_b")).join(one, (F.col("a") == F.col("_a")) & (F.col("salt") == F.col("_salt")))
    return joined.select("a", "b", "_one", "_two").mapInArrow(run, "a long, b long")


def similar_groups(docs: DataFrame, shingle: int = SIMILAR_SHINGLE, similarity: float = LEAST_SIMILARITY, words: int = WORDS) -> DataFrame:
    """row, doc_id and component_id (smallest id that links of similar texts reach) of every row of docs (doc_id, text)."""
    prints = written(_wide_prints(docs, shingle, words), "similar-prints")
    columns = [f"w{k}" for k in range(words)]
    # one row for each set of shingles: copies are one row from here on
    kinds = prints.groupBy("kind").agg(F.min("doc_id").alias("first_id"), F.min("row").alias("first_row"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in (*columns, "minima")])
    kinds = written(kinds, "similar-kinds")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs, "similar-pairs")
        named = kinds.select("kind", "first_row").join(pairs.select(F.explode(F.array("a", "b")).alias("_used")).distinct(), F.col("kind") == F.col("_used"), "left_semi")
        texts = docs.select(_row().alias("_row"), "text").join(named, F.col("_row") == F.col("first_row")).select("kind", "text").dropDuplicates(["kind"])
        return _verified(pairs, texts, shingle, similarity)

    roots = components(similar_pairs(kinds.select("kind", *columns), verified, words, similarity, keyed=_minima_keys(kinds)))
    rooted = kinds.join(roots, kinds["kind"] == roots["node"], "left").select("kind", "first_id", "n", F.coalesce("root", "kind").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.sum("n").alias("size"))
    labels = rooted.join(smallest.where("size > 1"), "root").select(F.col("kind").alias("_kind"), "component_id")
    return prints.join(labels, F.col("kind") == F.col("_kind"), "left").select("row", "doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_similar(docs: DataFrame, shingle: int = SIMILAR_SHINGLE, similarity: float = LEAST_SIMILARITY) -> DataFrame:
    """The rows of docs without those whose id is not the smallest of their group of similar texts; rows without an id stay."""
    spare = similar_groups(docs, shingle, similarity).where("doc_id <> component_id").select(F.col("row").alias("_spare"), F.col("doc_id").alias("_spare_id")).distinct()
    return docs.join(spare, (_row() == F.col("_spare")) & (docs["doc_id"] == F.col("_spare_id")), "left_anti")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
