"""Benchmark decontamination over a distributed positional inverted index.

The index stores a posting (term, document, position) for every training token whose term some
benchmark item uses; terms stand as 64-bit hashes. A document is its doc_id and a 64-bit hash of
its text (doc, key), so that texts under one id stay apart. Document frequencies come from the stored
postings. A window (8 consecutive item words, or a whole shorter item) is looked up by its
rarest term: each posting of it proposes a start, the position less the term's offset. The
list of the second rarest term, adjusted by its offset, is intersected next; what survives is
intersected with the other terms' lists, restricted to the surviving documents. Joins are on
(term, document, position), which no hot term or passage can skew. Text is read once and never
shuffled. All of it is DataFrame expressions.

The benchmark's vocabulary and windows are broadcast while their rows and bytes are few; beyond
that the same joins shuffle, both sides dealt by the key and SALTS parts of it, since a term or a
window may stand in a third of all documents.

near_matches() finds places where a window's terms stand close together, in any order, as in an item
whose words were changed or moved. A document alone tells them once the rarest terms are known, so
while the benchmark fits a broadcast no words are shuffled or stored; beyond that proximity() reads the
same postings.

Defined results: null or empty text has no words; an item without words or id has no windows;
items that share an id are one item; each row is judged by its own text alone, also where its
doc_id is null or repeated; no items: the digest of the empty string; an empty table gives an empty
one. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import LOWER, UPPER, alnum_words, except_keys, maybe_broadcast, stored, text_key

WIDTH = 8
LEAST_ITEMS = 2
#: Words that the terms of a near match may lie apart beyond the window's own.
SLACK = 4
SALTS = 32
_NO_ID = -(1 << 63)
#: What tells documents apart.
_DOC = ["doc", "key"]
#: ALNUM_GAP before lower-casing: capitals belong to words.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _term(word: Column) -> Column:
    """Hash of the word with A-Z lower-cased; lower() is the fast way for ASCII words."""
    low = F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))
    return F.xxhash64(low)


def _met(rows: DataFrame, small: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """rows (of documents) joined with small, a stored table of the benchmark's, by a key that may be hot in rows."""
    fit = small.count() == 0 or maybe_broadcast(small) is not small
    if fit:
        return rows.join(maybe_broadcast(small), on, how)
    part = F.pmod(F.xxhash64(*_DOC, *(c for c in ("pos", "start") if c in rows.columns)), F.lit(SALTS))
    spread = small.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("_part", part).join(spread, [on, "_part"], how).drop("_part")


def item_windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """item (string), window, k (words), terms (array of hashes) of the items' windows."""
    w = items.filter("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), alnum_words(F.col("text")).alias("w")).filter("size(w) > 0")
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - width + 1))).alias("at")
    cut = w.select("item", "w", at).select("item", F.slice("w", F.col("at"), F.lit(width)).alias("w"))
    return cut.select("item", F.xxhash64(F.array_join("w", " ")).alias("window"), F.size("w").alias("k"), F.transform("w", lambda x: F.xxhash64(x)).alias("terms")).distinct()


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Stored postings (term, doc, key, pos) of docs for terms. Term 0 at position n: a row of n words."""
    words = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), _GAP), lambda x: x != "")
    # in two steps: in one, Spark hashes the text again for each word
    keyed = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc"), text_key().alias("key"), F.array_append(words, F.lit("")).alias("words"))
    rows = keyed.select(*_DOC, F.posexplode("words").alias("pos", "word"))
    rows = rows.select(F.when(F.col("word") == "", F.lit(0).cast("long")).otherwise(_term(F.col("word"))).alias("term"), *_DOC, "pos")
    wanted = stored(terms.union(terms.sparkSession.range(1).select(F.lit(0).cast("long"))).distinct(), "terms")
    return stored(_met(rows, wanted, "term", "left_semi"), "postings")


def _by_rank(flat: DataFrame, df: DataFrame) -> DataFrame:
    """_ranked() of windows (window, k, terms), by stored frequencies (term, df)."""
    flat = flat.select("window", "k", F.posexplode("terms").alias("off", "term"))
    flat = flat.join(maybe_broadcast(df), "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    by = Window.partitionBy("window").orderBy("df", "off")
    return stored(flat.withColumn("rank", F.row_number().over(by)), "ranked")


def _ranked(postings: DataFrame, windows: DataFrame) -> DataFrame:
    """window, k, off, term, rank of each term of each window, rarest first. Stored."""
    df = stored(postings.groupBy("term").agg(F.count("*").alias("df")), "frequencies")
    return _by_rank(windows.select("window", "k", "terms").distinct(), df)


def phrases(postings: DataFrame, windows: DataFrame) -> DataFrame:
    """Exact matches: window, doc, key, start, k, distinct."""
    ranked = _ranked(postings, windows)
    of = lambda r, *columns: stored(ranked.filter(r).select(*columns), "rank")
    first = of("rank = 1", "window", "k", "off", "term")
    found = _met(postings, first, "term").select("window", "k", *_DOC, (F.col("pos") - F.col("off")).alias("start")).filter("start >= 0")
    two = _met(found.filter("k >= 2"), of("rank = 2", "window", F.col("term").alias("term2"), F.col("off").alias("off2")), "window")
    two = two.select("window", "k", *_DOC, "start", F.col("term2").alias("term"), (F.col("start") + F.col("off2")).alias("pos"))
    listed = _met(postings, stored(ranked.filter("rank = 2").select("term").distinct(), "second"), "term", "left_semi")
    met = two.join(listed, ["term", *_DOC, "pos"], "left_semi").select("window", "k", *_DOC, "start")
    alive = stored(found.filter("k = 1").unionByName(met).distinct(), "met")
    there = stored(alive.filter("k > 2").select(*_DOC).distinct(), "alive")
    held = postings.join(maybe_broadcast(there), _DOC, "left_semi")
    more = _met(alive.filter("k > 2"), of("rank > 2", "window", "term", "off"), "window").select("window", "k", *_DOC, "start", "term", (F.col("start") + F.col("off")).alias("pos"))
    whole = more.join(held, ["term", *_DOC, "pos"], "left_semi").groupBy("window", "k", *_DOC, "start").agg(F.count("*").alias("n")).filter("n = k - 2")
    return alive.filter("k <= 2").unionByName(whole.drop("n"))


def proximity(postings: DataFrame, windows: DataFrame, slack: int = SLACK) -> DataFrame:
    """window, doc, key, pos: places of a window's rarest term around which all its terms stand, in any
    order, no farther than k + slack words away."""
    ranked = _ranked(postings, windows)
    cell = (windows.agg(F.max("k")).first()[0] or 1) + slack
    at = _met(postings, stored(ranked.filter("rank = 1").select("window", "k", "term"), "rare"), "term").select("window", "k", *_DOC, "pos")
    at = stored(at, "rarest")
    rest = stored(ranked.filter("rank > 1").select("window", "term").distinct(), "rest")
    need = maybe_broadcast(stored(rest.groupBy("window").agg(F.count("*").alias("need")), "need"))
    near = _met(at, rest, "window").withColumn("cell", F.explode(F.array(*(F.floor(F.col("pos") / cell) + d for d in (-1, 0, 1)))))
    there = postings.select("term", *_DOC, F.col("pos").alias("p"), F.floor(F.col("pos") / cell).alias("cell"))
    hits = near.join(there, ["term", *_DOC, "cell"]).filter(F.abs(F.col("p") - F.col("pos")) <= F.col("k") + slack)
    got = hits.groupBy("window", *_DOC, "pos").agg(F.count_distinct("term").alias("n")).join(need, "window").filter("n = need").drop("n", "need")
    single = at.join(need, "window", "left_anti").select("window", *_DOC, "pos")
    return got.unionByName(single).distinct()


def _beside(docs: DataFrame, windows: DataFrame, slack: int) -> DataFrame | None:
    """proximity() of docs without a shuffle of words, where the benchmark fits a broadcast (else None).
    Texts are read twice: for frequencies of terms, and for the words beside each rarest term. Rows that
    share an id and a text count once in frequencies."""
    vocabulary = stored(windows.select(F.explode("terms").alias("term")).distinct(), "terms")
    flat = windows.select("window", "k", "terms").distinct()
    if maybe_broadcast(vocabulary) is vocabulary or maybe_broadcast(flat) is flat:
        return None
    keyed = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc"), text_key().alias("key"), "text")
    times = stored(keyed.groupBy(*_DOC).agg(F.count("*").alias("times")).filter("times > 1"), "repeated")
    words = F.transform(alnum_words(F.col("text")), lambda w: F.xxhash64(w)).alias("words")
    rows = keyed.join(maybe_broadcast(times), _DOC, "left").select(*_DOC, F.coalesce("times", F.lit(1)).alias("times"), words)
    used = rows.select("times", F.explode("words").alias("term")).join(F.broadcast(vocabulary), "term", "left_semi")
    df = used.groupBy("term", "times").agg(F.count("*").alias("n")).groupBy("term").agg(F.sum(F.expr("n div times")).alias("df"))
    ranked = _by_rank(flat, stored(df, "frequencies"))
    rare = ranked.groupBy("window", "k").agg(F.min_by("term", "rank").alias("term"), F.collect_set(F.when(F.col("rank") > 1, F.col("term"))).alias("rest"))
    rare = stored(rare.select("window", "term", "rest", (F.col("k") + slack).alias("far")), "rare")
    at = rows.select(*_DOC, "words", F.posexplode("words").alias("pos", "term")).join(F.broadcast(rare), "term")
    low = F.greatest(F.col("pos") - F.col("far"), F.lit(0))
    near = F.slice("words", low + 1, F.col("pos") + F.col("far") - low + 1)
    return at.filter(F.size(F.array_except("rest", near)) == 0).select("window", *_DOC, "pos")


def near_matches(docs: DataFrame, items: DataFrame, width: int = WIDTH, slack: int = SLACK) -> DataFrame:
    """item_id (string), doc_id, n_places: places of each document where the words of a window of the item
    stand close together; rows that share an id and a text count once."""
    windows = stored(item_windows(items, width), "windows")
    places = _beside(docs, windows, slack)
    if places is None:
        postings = stored(index(docs, windows.select(F.explode("terms").alias("term"))).distinct(), "postings")
        places = proximity(postings, windows, slack)
    named = _met(places, stored(windows.select("window", "item").distinct(), "names"), "window")
    per = named.select("item", *_DOC, "pos").distinct().groupBy("item", *_DOC).agg(F.count("*").alias("n_places"))
    return per.select(F.col("item").alias("item_id"), F.nullif("doc", F.lit(_NO_ID)).alias("doc_id"), "n_places")


def _covered(spans: Column) -> Column:
    """Words in the union of sorted (start, k) spans."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(a: Column, x: Column) -> Column:
        stop = x["start"] + x["k"]
        return F.struct(F.greatest(a["end"], stop).alias("end"), (a["n"] + F.greatest(F.lit(0), stop - F.greatest(a["end"], x["start"]))).alias("n"))

    return F.aggregate(spans, zero, step, lambda a: a["n"])


def _judged(docs: DataFrame, items: DataFrame, width: int, least_items: int) -> DataFrame:
    """The columns of report(), key and n_whole (items by windows of full width) for each row of docs."""
    windows = stored(item_windows(items, width), "windows")
    postings = index(docs, windows.select(F.explode("terms").alias("term")))
    matches = stored(phrases(postings, windows), "matches")
    hit = matches.groupBy(*_DOC).agg(F.sort_array(F.collect_set(F.struct("start", "k"))).alias("spans")).select(*_DOC, _covered(F.col("spans")).alias("n_hit"))
    names = stored(windows.select("window", "item", F.col("k") >= width).toDF("window", "item", "whole").distinct(), "names")
    named = _met(matches.select("window", *_DOC).distinct(), names, "window").groupBy(*_DOC)
    by = named.agg(F.sort_array(F.collect_set("item")).alias("items"), F.size(F.collect_set(F.when(F.col("whole"), F.col("item")))).cast("long").alias("n_whole"))
    found = hit.join(by, _DOC)
    rows = postings.filter("term = 0").select(*_DOC, F.col("pos").cast("long").alias("n_words")).join(found, _DOC, "left")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    n_items = F.size(items_).cast("long")
    return rows.select(
        F.nullif("doc", F.lit(_NO_ID)).alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), n_items.alias("n_items"),
        F.sha2(F.array_join(items_, ","), 256).alias("items_sha256"), (n_items >= least_items).alias("contaminated"), "key", F.coalesce("n_whole", F.lit(0).cast("long")).alias("n_whole"),
    )


def report(docs: DataFrame, items: DataFrame, width: int = WIDTH, least_items: int = LEAST_ITEMS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs."""
    return _judged(docs, items, width, least_items).drop("key", "n_whole")


def keep_clean(docs: DataFrame, items: DataFrame, width: int = WIDTH, least_items: int = 1, least_short: int | None = None) -> DataFrame:
    """The rows of docs, with their columns, in which fewer than least_items items have windows. Items
    shorter than a window are told by few words: with least_short, a document goes if least_items
    items have windows of full width or least_short items have any."""
    found = _judged(docs, items, width, least_items)
    bad = F.col("contaminated") if least_short is None else (F.col("n_whole") >= least_items) | (F.col("n_items") >= least_short)
    return except_keys(docs, stored(found.filter(bad).select("doc_id", F.col("key").alias("text_key")).distinct(), "bad"))
