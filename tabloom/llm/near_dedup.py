"""Near-duplicate documents by SetSketch registers.

A document is the set of its distinct word shingles. Its sketch holds registers, each the
exponentially spaced, truncated minimum of exponential variates of the shingles: registers of
a union are the maxima of the registers, and two sets agree in a register with a probability
that rises with their Jaccard similarity. Bands of register values make candidates; the
likelihood of the registers' order counts, given both set sizes, estimates the similarity; a
candidate whose estimate is within reach of the threshold is confirmed on the full sets.

How it keeps work in proportion to the input, whatever the sizes of the groups:

1. Documents with equal shingle sets form a class, known by a number; registers are kept with it.
2. In each band bucket every class is compared with the bucket's first one alone (hub): estimated
   on stored registers first; sets are fetched only for pairs that the estimate leaves.
3. Connected components of the confirmed links (large-star, small-star, on DataFrames).
4. Only buckets that still hold several components are looked at again: their members outside
   the bucket's most frequent component (strays) are compared exactly with all members of other
   components.

Comparisons run over groups of bounded size: a hub's or bucket's members are cut into blocks, a
hub is sent once for each block, and of the links between a stray and one component one is kept.

So every pair that shares a bucket is either confirmed, refuted on its full sets (or by an
estimate five standard deviations short), or already connected otherwise. A pair at exactly 0.8
shares no band with a probability of about 6e-5. exact=True finds those too: step 4 is repeated
with buckets of another kind, the rarest shingles of each set, of which similar sets share one.

Defined results: a text with fewer words than a shingle is one shingle, the whole sequence; no
words, empty or null text: no shingles, linked with nothing, kept; repeated rows of a document are
one class; equal texts under several ids are linked; each row is judged by its own text, also where
its doc_id is repeated. In link(), which answers with ids, a null doc_id is linked with nothing and
has a null component. In keep_one(), one row of each group stays, also among null ids and repeated
rows: that of the smallest id, null last. An empty table gives an empty one. Extra columns are not
read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import as_row, except_keys, maybe_broadcast, stored, text_key, unfolded
from tabloom.llm.hashing import WordHasher, finish, windows

WIDTH, THRESHOLD = 5, 80  # words of a shingle; similarity in hundredths
BANDS, ROWS = 32, 6
REGISTERS = BANDS * ROWS
BASE = 1.01
#: Standard deviations that an estimate may lie short of the threshold.
REACH = 5
#: Members of a hub that one group holds, about.
SPREAD = 64
#: Shingles of a bucket's members in one block: BLOCK while that makes at most BLOCKS of them, else as many as it takes, up to MOST.
BLOCK, BLOCKS, MOST = 25_000, 8, 2_000_000

_ODD = np.random.default_rng(20240229).integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1)


# --- sketches ------------------------------------------------------------------------------


def shingles(text: bytes | None, hasher: WordHasher, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes; bytes.lower() touches A-Z only, bytes.split() cuts at ASCII white space only."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(windows(hasher(words), min(width, len(words))))


def registers(s: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of shingle hashes, uint16.

    For each register an odd multiplier permutes the 32-bit hashes; the least value is a uniform
    minimum, its -log(1 - u) the minimum of exponential variates, its place on the scale of
    powers of BASE the register.
    """
    least = np.full(REGISTERS, np.iinfo(np.uint32).max, np.uint32)
    short = s.astype(np.uint32)
    for i in range(0, len(short), 512):
        np.minimum(least, np.multiply.outer(short[i : i + 512], _ODD).min(axis=0), out=least)
    e = -np.log1p(-(least + 0.5) / 2.0**32)
    return np.clip(np.floor(400 - np.log(e) / np.log(BASE)), 0, 65535).astype(np.uint16)


def band_keys(r: np.ndarray) -> np.ndarray:
    """A hash for each band of each row of registers: sets x BANDS."""
    parts = r.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    for i in range(0, ROWS, 3):  # three registers fit into a word
        key = finish(key * np.uint64(0x9E3779B97F4A7C15) + (parts[:, :, i] << np.uint64(32) | parts[:, :, i + 1] << np.uint64(16) | parts[:, :, i + 2]))
    return key.view(np.int64)


def estimate(ru: np.ndarray, rv: np.ndarray, nu: np.ndarray, nv: np.ndarray) -> np.ndarray:
    """Similarity of pairs by maximum likelihood: registers (pairs x REGISTERS) and set sizes.

    With shares u, v of the sizes, a register of U exceeds V's with probability p(u - v J), V's
    exceeds U's with p(v - u J), where p(x) = -log_BASE(1 - x (BASE - 1) / BASE).
    """
    more, less = (ru > rv).sum(1)[:, None], (ru < rv).sum(1)[:, None]
    u = (nu / (nu + nv))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1 - 1e-12)
    pu, pv = p(u - v * j), p(v - u * j)
    like = more * np.log(pu) + less * np.log(pv) + (REGISTERS - more - less) * np.log(np.clip(1 - pu - pv, 1e-12, 1))
    return np.take_along_axis(j, like.argmax(1)[:, None], 1)[:, 0]


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def _sketch(width: int):
    """doc_id, text_key, text to doc_id, text_key, n_shingles, set_key, registers (null for no shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for b in batches:
            n, keys, regs = [], [], []
            for text in _column(b, "text"):
                s = shingles(text, hasher, width)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                regs.append(registers(s).tobytes() if len(s) else None)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(regs, pa.binary())], names=["doc_id", "text_key", "n_shingles", "set_key", "registers"])

    return run


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """v, n, registers to v, n, band: a row for each band of a class."""
    for b in batches:
        for i in range(0, b.num_rows, 2000):
            part = b.slice(i, 2000)
            keys = band_keys(np.frombuffer(b"".join(_column(part, "registers")), np.uint16)).ravel()
            v, n = (np.repeat(part.column(k).to_numpy(zero_copy_only=False), BANDS) for k in (0, 1))
            yield pa.record_batch([pa.array(v, pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.int64())], names=["v", "n", "band"])


def _sets(width: int):
    """v, text to v, n, load: the shingles' bytes; each class once in a task, whatever its repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = WordHasher(), set()
        for b in batches:
            v, n, loads = [], [], []
            for k, text in zip(_column(b, "v"), _column(b, "text"), strict=True):
                if k not in seen:
                    seen.add(k)
                    s = shingles(text, hasher, width)
                    v.append(k)
                    n.append(len(s))
                    loads.append(s.tobytes())
            yield pa.record_batch([pa.array(v, pa.int64()), pa.array(n, pa.int64()), pa.array(loads, pa.binary())], names=["v", "n", "load"])

    return run


# --- comparisons ---------------------------------------------------------------------------

#: Of a group's rows: (probe, v, comp, n, load). Probes are compared with the others of other components.
Rows = list[tuple[bool, int, int, int, bytes]]


def _near(threshold: int) -> Callable[[Rows], list[tuple[int, int]]]:
    """Pairs whose estimated similarity is within reach of the threshold."""
    t = threshold / 100
    least = t - REACH * (t * (1 - t) / REGISTERS) ** 0.5

    def judge(rows: Rows) -> list[tuple[int, int]]:
        probes, others = [r for r in rows if r[0]], [r for r in rows if not r[0]]
        if not probes or not others:
            return []
        held, sizes = np.frombuffer(b"".join(r[4] for r in others), np.uint16).reshape(-1, REGISTERS), np.array([r[3] for r in others])
        out = []
        for _, v, _, n, load in probes:
            near = estimate(np.broadcast_to(np.frombuffer(load, np.uint16), held.shape), held, np.full(len(others), n), sizes)
            out += [(v, others[i][1]) for i in np.flatnonzero(near >= least)]
        return out

    return judge


def _similar(threshold: int) -> Callable[[Rows], list[tuple[int, int]]]:
    """Pairs that are similar on their full sets, of a probe and a component one. Members lie in
    order of size, so that a probe meets only those whose size allows it."""

    def judge(rows: Rows) -> list[tuple[int, int]]:
        probes, others = [r for r in rows if r[0]], sorted((r for r in rows if not r[0]), key=lambda r: r[3])
        if not probes or not others:
            return []
        sizes, comps = np.array([r[3] for r in others]), np.array([r[2] for r in others])
        every, at = np.frombuffer(b"".join(r[4] for r in others), np.uint64), np.concatenate([[0], np.cumsum(sizes)])
        out = {}
        for _, v, comp, n, load in probes:
            low, high = np.searchsorted(100 * sizes, threshold * n, "left"), np.searchsorted(threshold * sizes, 100 * n, "right")
            if low >= high:
                continue
            own, met = np.frombuffer(load, np.uint64), every[at[low] : at[high]]
            hit = own[np.minimum(np.searchsorted(own, met), n - 1)] == met
            common = np.add.reduceat(hit.astype(np.int64), at[low:high] - at[low])
            for i in np.flatnonzero(100 * common >= threshold * (sizes[low:high] + n - common)) + low:
                if comps[i] != comp:
                    out.setdefault((v, comps[i]), others[i][1])
        return [(v, w) for (v, _), w in out.items()]

    return judge


def _each_group(judge: Callable[[Rows], list[tuple[int, int]]]):
    """judge over runs of equal (g, i, j) in sorted partitions, whatever batches they fall in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for b in batches:
            out = []
            for g, i, j, *row in zip(*(_column(b, c) for c in ("g", "i", "j", "probe", "v", "comp", "n", "load")), strict=True):
                if (g, i, j) != key:
                    out += judge(rows)
                    key, rows = (g, i, j), []
                rows.append(tuple(row))
            yield pa.record_batch([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
        out = judge(rows)
        yield pa.record_batch([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _compared(rows: DataFrame, judge: Callable[[Rows], list[tuple[int, int]]]) -> DataFrame:
    dealt = rows.select("g", "i", "j", "probe", "v", "comp", "n", "load").repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
    return dealt.mapInArrow(_each_group(judge), "a long, b long")


def _part(n: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64("v", F.lit(salt)), n).cast("int")


def _stars(pairs: DataFrame, loads: DataFrame, judge: Callable[[Rows], list[tuple[int, int]]]) -> DataFrame:
    """The pairs (a, b, blk) that judge leaves; loads: v, n, load of both sides. A hub a goes once to
    each of its blocks."""
    whole = lambda df, probe: df.select(F.col("a").alias("g"), F.col("blk").alias("i"), F.lit(0).alias("j"), F.lit(probe).alias("probe"), "v", F.col("v").alias("comp"), "n", "load")
    hubs = pairs.select("a", "blk").distinct().join(loads, F.col("a") == F.col("v"))
    members = pairs.join(loads, F.col("b") == F.col("v"))
    return _compared(whole(hubs, True).unionByName(whole(members, False)), judge)


def _strays(members: DataFrame, label: DataFrame, fetch: Callable[[DataFrame], DataFrame], threshold: int) -> DataFrame:
    """Links that join components within buckets. members: g (bucket), v, n; label: v, comp."""
    m = members.join(label, "v", "left").withColumn("comp", F.coalesce("comp", "v"))
    by = m.groupBy("g", "comp").agg(F.count("*").alias("k"), F.sum("n").alias("w"))
    split = by.groupBy("g").agg(F.count("*").alias("comps"), F.max(F.struct("k", "w", "comp")).alias("main"), F.sum("w").alias("w")).filter("comps > 1")

    def blocks(w: Column) -> Column:
        few = F.ceil(w / BLOCK)
        return F.when(few <= BLOCKS, few).otherwise(F.greatest(F.lit(BLOCKS), F.ceil(w / MOST))).cast("int")

    split = stored(split.select("g", F.col("main.comp").alias("main"), blocks(F.col("w")).alias("bm"), blocks(F.col("w") - F.col("main.w")).alias("bs")), "split")
    open_ = stored(m.join(maybe_broadcast(split), "g"), "open")
    sets = fetch(open_.select("v").distinct())
    full = open_.drop("n").join(sets, "v").withColumn("odd", F.col("comp") != F.col("main"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    base = ["g", "v", "comp", "n", "load"]
    strays = full.filter("odd").select(*base, F.lit(True).alias("probe"), _part(F.col("bs"), 1).alias("i"), spread(F.col("bm")).alias("j"))
    others = full.select(*base, F.lit(False).alias("probe"), spread(F.col("bs")).alias("i"), _part(F.col("bm"), 2).alias("j"))
    return _compared(strays.unionByName(others), _similar(threshold)).distinct()


# --- links ---------------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """links (a, b) to (v, comp): each vertex with the smallest one reachable. Stored."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    mark = None
    while True:
        # large-star: larger neighbours of u go to the least of u and its neighbours
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: u and its smaller neighbours go to the least of these
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        edges = stored(small, "edges")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("v")).distinct().withColumn("comp", F.col("v"))
    return edges.select(F.col("u").alias("v"), F.col("v").alias("comp")).union(roots)


def _rarest(sets: DataFrame, threshold: int) -> DataFrame:
    """g, v, n: as many of each set's rarest shingles that similar sets must share one of them."""
    each = sets.mapInArrow(_as_lists, "v long, n long, s array<long>").dropDuplicates(["v"]).select("v", "n", F.explode("s").alias("g"))
    each = stored(each, "shingles")
    often = each.groupBy("g").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = each.join(often, "g").groupBy("v", "n").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("s"))
    # what stands in no other set comes first and takes up places
    own = F.col("n") - F.size("s")
    places = F.col("n") - F.ceil(F.col("n") * threshold / 100) + 1 - own
    return ranked.filter(places > 0).select("v", "n", F.explode(F.slice("s", F.lit(1), places.cast("int"))).alias("x")).select("x.g", "v", "n")


def _as_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = [np.frombuffer(x, np.int64) for x in _column(b, "load")]
        yield pa.record_batch([b.column(0), b.column(1), pa.array(lists, pa.list_(pa.int64()))], names=["v", "n", "s"])


def _labels(docs: DataFrame, classes: DataFrame, width: int, threshold: int, exact: bool) -> DataFrame:
    """v, comp of the classes (v, doc_id, text_key, n, registers) that are linked with another."""
    texts = docs.select(F.col("doc_id").alias("_doc"), text_key().alias("_key"), F.col("text").cast("binary").alias("text"))

    def fetch(wanted: DataFrame) -> DataFrame:
        """v, n, load of the classes wanted (v), from their first documents' texts."""
        named = stored(wanted.join(classes.select("v", "doc_id", "text_key"), "v"), "wanted")
        held = texts.join(maybe_broadcast(named), F.col("_doc").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("text_key")))
        return stored(held.select("v", "text").mapInArrow(_sets(width), "v long, n long, load binary"), "sets")

    banded = classes.select("v", "n", "registers").mapInArrow(_banded, "v long, n long, band long")
    buckets = stored(banded.groupBy("band").agg(F.count("*").alias("size"), F.min("v").alias("hub")).filter("size > 1"), "buckets")
    members = stored(banded.join(maybe_broadcast(buckets), "band"), "members")
    pairs = members.filter("v <> hub").groupBy(F.col("hub").alias("a"), F.col("v").alias("b")).agg(F.max("size").alias("size"))
    pairs = stored(pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("size") / SPREAD)).cast("int").alias("blk")), "pairs")
    left = _stars(pairs, classes.select("v", "n", F.col("registers").alias("load")), _near(threshold))
    left = stored(left.distinct().join(pairs, ["a", "b"]), "near")
    sets = fetch(left.select(F.explode(F.array("a", "b")).alias("v")).distinct())
    links = stored(_stars(left, sets, _similar(threshold)).distinct(), "links")
    label = stored(components(links), "labels")
    links = stored(links.union(_strays(members.filter("size > 2").select(F.col("band").alias("g"), "v", "n"), label, fetch, threshold)), "links")
    if not exact:
        return stored(components(links), "labels")
    label = stored(components(links), "labels")
    rare = stored(_rarest(fetch(classes.select("v")), threshold), "rare")
    return stored(components(links.union(_strays(rare, label, fetch, threshold))), "labels")


def _grouped(docs: DataFrame, width: int, threshold: int, exact: bool, nulls: bool) -> tuple[DataFrame, DataFrame]:
    """sketched (doc_id, text_key, n_shingles, set_key of each row) and, for each set_key, its class's
    first document (doc_id, text_key) and the first one of its component (top). Rows without a doc_id
    take part if nulls."""
    read = docs.select("doc_id", text_key().alias("text_key"), F.col("text").cast("binary").alias("text"))
    sketched = stored(read.mapInArrow(_sketch(width), "doc_id long, text_key long, n_shingles long, set_key binary, registers binary"), "sketches")
    whole = sketched.filter("n_shingles > 0" if nulls else "n_shingles > 0 AND doc_id IS NOT NULL")
    one = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_key"))
    met = whole.groupBy("set_key").agg(one.alias("one"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"))
    classes = stored(met.select(F.monotonically_increasing_id().alias("v"), "set_key", "one.doc_id", "one.text_key", "copies", "n", "registers"), "classes")
    label = _labels(docs, classes, width, threshold, exact)
    linked = stored(classes.drop("n", "registers").join(label, "v"), "linked")
    first = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_key")
    tops = stored(linked.groupBy("comp").agg(F.min(first).alias("top")), "tops")
    met = linked.join(maybe_broadcast(tops), "comp")
    # most classes are alone in their component and need no join with it
    alone = classes.join(label, "v", "left_anti").withColumn("top", first)
    kept = ["set_key", "copies", "doc_id", "text_key", "top"]
    return sketched.drop("registers"), met.select(*kept).unionByName(alone.select(*kept))


def link(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs."""
    sketched, classes = _grouped(docs, width, threshold, exact, nulls=False)
    grouped = classes.filter((F.col("copies") > 1) | (F.col("top.doc_id") != F.col("doc_id"))).select("set_key", F.col("top.doc_id").alias("comp"))
    out = sketched.join(maybe_broadcast(stored(grouped, "grouped")), "set_key", "left")
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", "n_shingles", found.alias("component_id"), F.coalesce(F.col("doc_id") == found, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD, exact: bool = False) -> DataFrame:
    """One row of docs for each group, with the columns of docs: that of the smallest doc_id, null last."""
    sketched, classes = _grouped(docs, width, threshold, exact, nulls=True)
    top = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_key")
    several = classes.filter((F.col("copies") > 1) | (F.col("top") != top)).select("set_key", "top")
    rows = stored(sketched.join(maybe_broadcast(stored(several, "grouped")), "set_key").select("doc_id", "text_key", (F.col("top") == top).alias("first")), "rows")
    keys = rows.groupBy("doc_id", "text_key").agg(F.first("first").alias("first"), F.count("*").alias("n"))
    keys = stored(keys.filter("n > 1 OR NOT first"), "keys")
    once = except_keys(docs, keys.select("doc_id", "text_key"))
    # a row that is to stay but stands there several times
    again = stored(keys.filter("first").select("doc_id", "text_key"), "again")
    held = as_row(docs, _doc=F.col("doc_id"), _key=text_key())
    held = held.join(maybe_broadcast(again), F.col("_doc").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("text_key")), "left_semi")
    return once.unionByName(unfolded(held.dropDuplicates(["_doc", "_key"])))
