"""Near-duplicate groups by MinHash with tensored banding.

A text's set holds the hashes of its distinct word shingles; texts with equal sets form one class, and only
the lowest id of a class is looked at further.  Two sides of ``m`` small collections of two minhashes each are
computed, and each of the ``m * m`` table keys pairs one collection of either side: keys of four minhashes cost
``4 m`` of them instead of ``4 m * m``.  ``m`` follows from the similarity and the share of links that all
tables may miss.  Candidates are verified on the full sets.

Buckets never become all their pairs:

1. Every member of a bucket is compared with its most popular member (the one met most often over all
   tables), and verified links are united to components.
2. Only buckets that still hold several components are looked through for links between different components.
   In a bucket of up to ``SMALL`` members, pairs whose sizes and signatures allow the similarity are listed, each
   in its first common table, and verified.  A larger bucket is dealt out as pairs of tiles together with the
   texts; a task computes all common shingles of its tiles as a matrix product and hands on only links that
   unite what is apart, at most one per member.

Texts without words have empty sets and link with nothing.  Rows with a null id link with nothing and stay.
Repeated rows get the same result.  If different texts share an id, one of them takes part in links, and the
others form groups with their exact copies only.  Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.llm.common import blocks, nullable_ids, small_batches, texts
from facetry.llm.textscan import U64, Scan, mix, windows
from facetry.operators.hops import components
from facetry.session import cut, forget

#: Minhashes per collection.
SIZE = 2
#: Share of links at the very threshold that no table shows.
MISS = 1e-4
#: Members of a bucket up to which its pairs are listed, and of a tile of a larger one.
SMALL = 128
TILE = 1536
#: Columns of the matrix of common shingles that are held at once.
COLUMNS = 2048
#: Rows of that matrix that are compared at once.
ROWS = 256
#: Words of 64 bits of the map that tells rows without a partner apart before a shuffle.
MAP_WORDS = 1 << 18


def collections_needed(percent: int, miss: float = MISS) -> int:
    """Collections per side so that at most ``miss`` of the links at the threshold share no table key."""
    alone = 1 - (percent / 100) ** SIZE
    m = 1
    while 1 - (1 - alone**m) ** 2 > miss:
        m += 1
    return m


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20).integers(1, 1 << 63, n, dtype=np.uint64) * U64(2) + U64(1)


def shingle_sets(raw: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (A-Z lowered); fewer words than ``size`` make one shingle."""
    scan = Scan(raw, lower=True)
    begin, end, doc = scan.words()
    word = scan.hashes(begin, end)
    h, first = windows(word, doc, size)
    n = len(raw)
    words = np.searchsorted(doc, np.arange(n + 1))
    at = np.searchsorted(doc[first], np.arange(n + 1)) if len(first) else np.zeros(n + 1, int)
    out = []
    for i in range(n):
        if at[i] < at[i + 1]:
            out.append(np.unique(h[at[i] : at[i + 1]]))
        elif words[i] < words[i + 1]:
            few = word[words[i] : words[i + 1]]
            whole = np.full(1, len(few), U64)
            for k in range(len(few)):
                whole = mix(whole * U64(0x9E3779B97F4A7C15) + few[k : k + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, U64))
    return out


def signatures(sets: list[np.ndarray], functions: np.ndarray) -> np.ndarray:
    """Low 32 bits of every minhash; texts x functions; zeros for empty sets."""
    full = [i for i, s in enumerate(sets) if len(s)]
    out = np.zeros((len(sets), len(functions)), "<u4")
    if full:
        flat = np.concatenate([sets[i] for i in full])
        starts = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
        for k, a in enumerate(functions):
            low = np.minimum.reduceat(flat * a, starts)
            out[full, k] = (mix(low) & U64(0xFFFFFFFF)).astype("<u4")
    return out


def _sketches(docs: DataFrame, key: str, text: str, size: int, m: int) -> DataFrame:
    functions = _multipliers(2 * m * SIZE)

    def run(batches):
        for pdf in blocks(batches):
            sets = shingle_sets(list(pdf["text"]), size)
            sums = [(int(s.sum(dtype=U64)), int(mix(s).sum(dtype=U64))) for s in sets]
            both = np.array(sums, U64).reshape(len(sets), 2).view(np.int64)
            yield pd.DataFrame(
                {
                    "doc_id": nullable_ids(pdf["doc_id"]),
                    "tid": pdf["tid"].to_numpy(),
                    "n_shingles": [len(s) for s in sets],
                    "d1": both[:, 0],
                    "d2": both[:, 1],
                    "sig": [row.tobytes() for row in signatures(sets, functions)],
                }
            )

    schema = "doc_id long, tid long, n_shingles long, d1 long, d2 long, sig binary"
    return texts(docs, key, text, binary=True).withColumn("tid", F.xxhash64("text")).mapInPandas(run, schema)


def _collections(sig: pd.Series, m: int) -> np.ndarray:
    """Hash of each collection of each side; rows x 2m."""
    raw = np.frombuffer(b"".join(sig), "<u4").reshape(len(sig), 2 * m, SIZE).astype(U64)
    h = raw[:, :, 0]
    for k in range(1, SIZE):
        h = mix(h * U64(0x9E3779B97F4A7C15) + raw[:, :, k])
    return mix(h + np.arange(2 * m, dtype=U64)[None, :])


def _slots(reps: DataFrame, m: int) -> DataFrame:
    def run(batches):
        for pdf in batches:
            if len(pdf):
                h = _collections(pdf["sig"], m).view(np.int64)
                yield pd.DataFrame({"rep": pdf["rep"], "values": list(h)})

    return reps.select("rep", "sig").mapInPandas(run, "rep long, values array<long>")


def _met(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with ``_met``: false only where no row of ``keys`` has the same ``on``.

    The keys set bits of a broadcast map of at most ``MAP_WORDS`` rows, however many they are, so that most texts without a partner
    need not travel.  Rows that share a bit by chance pass as well: an exact join has to follow.
    """
    bit = F.pmod(F.xxhash64(*on), F.lit(64 * MAP_WORDS).cast("long"))
    word = keys.select(bit.alias("_met_bit")).select(
        F.shiftright("_met_bit", 6).alias("_met_word"), F.expr("shiftleft(1L, cast(_met_bit % 64 as int))").alias("_met_set")
    )
    word = word.groupBy("_met_word").agg(F.bit_or("_met_set").alias("_met_set"))
    rows = rows.withColumn("_met_bit", bit).withColumn("_met_word", F.shiftright("_met_bit", 6)).join(F.broadcast(word), "_met_word", "left")
    met = F.expr("coalesce(_met_set & shiftleft(1L, cast(_met_bit % 64 as int)), 0L) <> 0")
    return rows.withColumn("_met", met).drop("_met_bit", "_met_word", "_met_set")


def _bodies(wanted: DataFrame, reps: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(doc_id, text)`` of the ids ``(rep)``; the text an id stands for is the one its class was made of."""
    wanted = cut(wanted.join(reps.select("rep", "tid"), "rep").withColumnRenamed("rep", "doc_id").select("doc_id", "tid"))
    body = texts(docs, key, text, binary=True).withColumn("tid", F.xxhash64("text"))
    body = _met(body, wanted, ["doc_id", "tid"]).filter("_met").drop("_met")
    # one row of repeated ones; the columns are those of the join, so nothing is shuffled again
    return cut(body.join(wanted, ["doc_id", "tid"]).dropDuplicates(["doc_id", "tid"]).select("doc_id", "text"))


def _verify(pairs: DataFrame, body: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs ``(i, j)`` of ids whose full sets are similar enough."""
    with_i = pairs.join(body.select(F.col("doc_id").alias("i"), F.col("text").alias("text_i")), "i")
    with_both = with_i.join(body.select(F.col("doc_id").alias("j"), F.col("text").alias("text_j")), "j")

    def run(batches):
        for pdf in batches:
            pdf = pdf.assign(_size=pdf["text_i"].map(len) + pdf["text_j"].map(len))
            for part in _by_size(pdf):
                ids = dict(zip(part["i"], part["text_i"])) | dict(zip(part["j"], part["text_j"]))
                sets = dict(zip(ids, shingle_sets(list(ids.values()), size)))
                good = []
                for i, j in zip(part["i"], part["j"]):
                    a, b = sets[i], sets[j]
                    common = len(np.intersect1d(a, b, assume_unique=True))
                    good.append(len(a) > 0 and 100 * common >= percent * (len(a) + len(b) - common))
                yield part.loc[good, ["i", "j"]]

    return cut(with_both.select("i", "j", "text_i", "text_j").mapInPandas(run, "i long, j long").distinct())


def _by_size(pdf: pd.DataFrame, limit: int = 8 << 20):
    group = (pdf["_size"].cumsum() - 1) // limit
    for _, part in pdf.groupby(group.to_numpy(), sort=False):
        yield part


def _groups(batches, columns: list[str]):
    """Whole groups of rows that arrive sorted by ``columns``."""
    held = None
    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf])
        if not len(pdf):
            continue
        last = np.ones(len(pdf), bool)
        for c in columns:
            last &= (pdf[c] == pdf[c].iloc[-1]).to_numpy()
        held = pdf[last]
        for _, g in pdf[~last].groupby(columns, sort=False):
            yield g
    if held is not None and len(held):
        yield held


def _listed_pairs(rows: DataFrame, m: int, percent: int) -> DataFrame:
    """Plausible pairs ``(i, j)`` of different components within each bucket of ``(key, table, rep, n, root, sig)``."""
    functions = 2 * m * SIZE
    share = percent / 100
    # far enough below the mean that a true link practically never falls under it
    least = max(0, math.floor(functions * share - 5.5 * math.sqrt(functions * share * (1 - share))))

    def run(batches):
        for g in _groups(batches, ["key"]):
            ids, n, root = g["rep"].to_numpy(), g["n"].to_numpy(), g["root"].to_numpy()
            sig = np.frombuffer(b"".join(g["sig"]), "<u4").reshape(len(g), functions)
            own = _collections(g["sig"], m)
            p, q = np.triu_indices(len(g), 1)
            keep = (root[p] != root[q]) & (100 * np.minimum(n[p], n[q]) >= percent * np.maximum(n[p], n[q]))
            p, q = p[keep], q[keep]
            same = own[p] == own[q]
            first = same[:, :m].argmax(1) * m + same[:, m:].argmax(1)
            keep = (first == int(g["table"].iloc[0])) & ((sig[p] == sig[q]).sum(1) >= least)
            if keep.any():
                p, q = ids[p[keep]], ids[q[keep]]
                yield pd.DataFrame({"i": np.minimum(p, q), "j": np.maximum(p, q)})

    dealt = rows.repartition("key").sortWithinPartitions("key")
    return dealt.mapInPandas(run, "i long, j long").distinct()


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Number of common elements of every two sets; a matrix product over the elements that occur twice."""
    n = len(sets)
    flat = np.concatenate(sets) if n else np.zeros(0, U64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, element, times = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    shared = times[element] > 1
    row, column = owner[shared], number[element[shared]]
    out = np.zeros((n, n), np.float32)  # exact up to 2^24 common elements
    for k in range(0, int(number[-1]) + 1 if len(number) else 0, COLUMNS):
        part = (column >= k) & (column < k + COLUMNS)
        x = np.zeros((n, COLUMNS), np.float32)
        x[row[part], column[part] - k] = 1
        out += x @ x.T
    return out


def _close_pairs(sets: list[np.ndarray], percent: int, apart) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``a < b`` of similar sets for which ``apart(rows)`` allows it."""
    common, n = common_counts(sets), np.array([len(s) for s in sets], np.int64)
    left, right = [], []
    for r in range(0, len(sets), ROWS):
        rows = slice(r, min(len(sets), r + ROWS))
        both = common[rows].astype(np.int64)
        a, b = np.nonzero((100 * both >= percent * (n[rows, None] + n[None, :] - both)) & apart(rows))
        left.append(a[a + r < b] + r)
        right.append(b[a + r < b])
    return np.concatenate(left), np.concatenate(right)


def spanning(a: np.ndarray, b: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links ``(a, b)`` enough to unite all that they unite, starting from the components ``root``."""
    _, root = np.unique(root, return_inverse=True)
    parent = np.arange(root.max(initial=-1) + 1)
    left, right = [], []
    while True:
        ra, rb = parent[root[a]], parent[root[b]]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        if not len(a):
            none = np.zeros(0, np.int64)
            return (np.concatenate(left), np.concatenate(right)) if left else (none, none)
        # one link per component to be hung up under a lower one, so no circle closes
        high, low = np.maximum(ra, rb), np.minimum(ra, rb)
        _, first = np.unique(high, return_index=True)
        left.append(a[first])
        right.append(b[first])
        parent[high[first]] = low[first]
        while (parent[parent] != parent).any():
            parent = parent[parent]


def _tile_links(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Links ``(i, j)`` that unite components within large buckets of ``(key, cnt, rep, root, text)``."""
    tiles = F.ceil(F.col("cnt") / TILE).cast("long")
    rows = rows.withColumn("_tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("_tiles")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tiles") - 1)))
    group = ["key", "ti", "tj"]
    rows = rows.select(
        "key", F.least("tile", "other").alias("ti"), F.greatest("tile", "other").alias("tj"), "tile", "rep", "root", "text"
    )

    def run(batches):
        for g in _groups(batches, group):
            side, ti, tj = g["tile"].to_numpy(), int(g["ti"].iloc[0]), int(g["tj"].iloc[0])
            root = g["root"].to_numpy()
            if (root == root[0]).all():
                continue
            def apart(rows, root=root, side=side, across=ti != tj):
                other = root[rows, None] != root[None, :]
                return other & (side[rows, None] != side[None, :]) if across else other

            a, b = spanning(*_close_pairs(shingle_sets(list(g["text"]), size), percent, apart), root)
            if len(a):
                ids = g["rep"].to_numpy(np.int64)
                yield pd.DataFrame({"i": ids[a], "j": ids[b]})

    return rows.repartition(*group).sortWithinPartitions(*group).mapInPandas(run, "i long, j long").distinct()


def near_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, miss: float = MISS
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row; links need ``100 * common >= percent * union``."""
    return _grouped_texts(docs, key, text, size, percent, miss).drop("tid")


def _grouped_texts(docs: DataFrame, key: str, text: str, size: int, percent: int, miss: float) -> DataFrame:
    """The rows of :func:`near_groups` with the hash of their text, ``tid``."""
    small_batches(docs.sparkSession)
    m = collections_needed(percent, miss)
    sketches = cut(_sketches(docs, key, text, size, m))
    of_class = ["d1", "d2", "n_shingles"]
    useful = sketches.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    lowest = useful.groupBy(*of_class).agg(F.min(F.struct("doc_id", "tid")).alias("_low"), F.first("sig").alias("sig"))
    classes = cut(lowest.select(*of_class, F.col("_low.doc_id").alias("rep"), F.col("_low.tid").alias("tid"), "sig"))
    # of several texts under one id one takes part in links, the others stay with their own copies
    one = classes.groupBy("rep").agg(F.min(F.struct("tid", F.col("n_shingles").alias("n"), "sig")).alias("_one"))
    reps = one.select("rep", "_one.*")

    # Counts are written before they are joined: both sides of such a join then come straight from a shuffle, so
    # that adaptive execution can split a hot key.
    # A key can only be shared where the values of both of its collections are.
    slots = _slots(reps, m).select("rep", F.posexplode("values").alias("slot", "value"))
    shared = slots.groupBy("slot", "value").agg(F.count("*").alias("_n")).filter(F.col("_n") > 1).drop("_n")
    shared = cut(shared)
    useful = slots.join(shared, ["slot", "value"]).groupBy("rep").agg(F.collect_list(F.struct("slot", "value")).alias("s"))
    side_a = F.filter("s", lambda e: e["slot"] < m)
    side_b = F.filter("s", lambda e: e["slot"] >= m)
    # two explodes over at most m entries each: the keys of one document
    keyed = useful.select("rep", F.explode(side_a).alias("a"), side_b.alias("bs")).select(
        "rep", "a", F.explode("bs").alias("b")
    )
    keyed = keyed.select(
        "rep",
        (F.col("a.slot") * m + F.col("b.slot") - m).cast("int").alias("table"),
        F.xxhash64("a.slot", "a.value", "b.slot", "b.value").alias("key"),
    )
    keyed = cut(keyed)
    sizes = cut(keyed.groupBy("key").agg(F.count("*").alias("cnt")).filter(F.col("cnt") > 1))
    members = cut(keyed.join(sizes, "key"))
    popular = members.groupBy("rep").agg(F.sum("cnt").alias("pop")).join(reps.select("rep", "n"), "rep")
    ranked = members.join(popular, "rep")
    centre = ranked.groupBy("key").agg(F.max(F.struct("pop", (-F.col("rep")).alias("c"), F.col("n").alias("cn"))).alias("_c"))
    centre = cut(centre)
    star = ranked.join(centre, "key").filter(F.col("rep") != -F.col("_c.c"))
    star = star.filter(100 * F.least("n", "_c.cn") >= percent * F.greatest("n", "_c.cn"))
    star = cut(star.select(F.col("rep").alias("i"), (-F.col("_c.c")).alias("j")).distinct())
    # the texts of all that met anybody: what follows reads them instead of the whole table
    bodies = _bodies(popular.select("rep"), reps, docs, key, text)
    links = _verify(star, bodies, size, percent)
    nodes = cut(popular.select(F.col("rep").alias("node")))
    found = components(links, nodes)

    in_component = members.join(found.withColumnRenamed("node", "rep"), "rep")
    still_open = in_component.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    still_open = still_open.filter(F.col("lo") < F.col("hi")).select("key")
    still_open = cut(still_open)
    rows = cut(in_component.join(still_open, "key").select("key", "table", "cnt", "rep", "root"))
    listed = rows.filter(F.col("cnt") <= SMALL).join(reps.select("rep", "n", "sig"), "rep")
    more = cut(_listed_pairs(listed, m, percent))
    new_links = _verify(more, bodies, size, percent)
    large = rows.filter(F.col("cnt") > SMALL).drop("table")
    tiled = cut(_tile_links(large.join(bodies.withColumnRenamed("doc_id", "rep"), "rep"), size, percent))
    forget(shared, keyed, sizes, members, centre, star, still_open, more, bodies, rows)
    if not (new_links.isEmpty() and tiled.isEmpty()):
        found = components(links.unionByName(new_links).unionByName(tiled), nodes)

    found = found.withColumnRenamed("node", "rep").join(reps.select("rep", "tid"), "rep")
    named = classes.drop("sig").join(found, ["rep", "tid"], "left")
    named = named.select(*of_class, F.coalesce("root", "rep").alias("_root"))
    out = sketches.drop("sig").join(named, of_class, "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("_root", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(component)
    return out.select(
        "doc_id", "tid", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def one_of_each_group(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, miss: float = MISS
) -> DataFrame:
    """The rows of ``docs`` that stay of their groups, with all columns; rows without an id stay.

    A row goes by its id and the hash of its text: of several texts under one id only those that have to go do.  Only rows that
    may have to go are shuffled.
    """
    groups = _grouped_texts(docs, key, text, size, percent, miss)
    gone = cut(groups.filter(~F.col("kept")).select(F.col("doc_id").alias("_gone_id"), F.col("tid").alias("_gone_tid")).distinct())
    body = F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit("")).cast("binary"))
    marked = _met(docs.withColumns({"_gone_id": docs[key].cast("long"), "_gone_tid": body}), gone, ["_gone_id", "_gone_tid"])
    stay = marked.filter(~F.col("_met"))
    doubtful = marked.filter("_met").join(gone, ["_gone_id", "_gone_tid"], "left_anti")
    return stay.drop("_gone_id", "_gone_tid", "_met").unionByName(doubtful.drop("_gone_id", "_gone_tid", "_met"))
