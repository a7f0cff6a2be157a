"""Jaccard similarity join of word shingles: a size-aware heavy-light join that gives each document its connected component."""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import release
from .common import blocks_of, checkpointed, mix, places, text_bytes, total, windows_hash, words_of
from .components import connected
from .exchange import BLOCKS, FEWEST, answered, blocks, chunked, distinct_with_owners, held_elsewhere, replies

_SETS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("shingles", pa.binary())])
SETS = "row long, doc_id long, n_shingles long, digest binary, shingles binary"
_LISTS = pa.schema([("e", pa.int64()), ("rep", pa.int64()), ("n", pa.int64()), ("shared", pa.int64()), ("taken", pa.int64()), ("pos", pa.int64())])
LISTS = "e long, rep long, n long, shared long, taken long, pos long"


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of n has in common with any set it links with, at least."""
    return -(-percent * n // 100)


def pair_overlap(a: int, b: int, percent: int) -> int:
    """Least intersection of linked sets of these sizes."""
    return -(-percent * (a + b) // (100 + percent))


def row_order(t: pa.Table) -> np.ndarray:
    """Order of a chunk's rows by id and key, which does not hang on how they came; rows that are equal in both are equal in id and text."""
    return np.lexsort((t.column("key").to_numpy(), t.column("doc_id").fill_null(np.iinfo(np.int64).max).to_numpy()))


def dealt(docs: DataFrame, chunks: int) -> DataFrame:
    """Rows (doc_id, text, ...) in chunks, with the key of row_order."""
    return chunked(docs.withColumn("key", F.xxhash64("text", F.lit(29))), chunks, "doc_id", "text")


def distinct_shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, number of each text): distinct shingles, sorted by hash within each text."""
    _, _, word, first = words_of(data, offsets, lower=True)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    left = first[doc + 1] - np.arange(len(word))
    starts, hashes = [np.flatnonzero(left >= words)], []
    hashes.append(windows_hash(word, starts[0], words, 1))
    for k in range(1, words):  # a text with fewer words is one sequence
        starts.append(first[:-1][n == k])
        hashes.append(windows_hash(word, starts[-1], k, 1))
    h, d = np.concatenate(hashes), doc[np.concatenate(starts)]
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], np.bincount(d[new], minlength=len(n))


class Shingles:
    """Distinct shingles of a chunk's texts, sorted by hash within each text; texts in the order of row_order."""

    def __init__(self, t: pa.Table, words: int):
        self.order = row_order(t)
        data, offsets = text_bytes(t.column("text"))
        parts = [distinct_shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words) for a, b in blocks_of(offsets, 1 << 19)]
        self.hash = np.concatenate([h for h, _ in parts]) if parts else np.zeros(0, np.uint64)
        n = np.concatenate([k for _, k in parts]) if parts else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(n)])
        self.n = n

    def probes(self, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entries that probe for partners, their text, how many a text with a partner must share): the lowest hashes of each text.

        A linked set lacks n - least of a set's shingles at most, so of any p of them it has p - (n - least) at least.
        """
        spare = self.n - -(-percent * self.n // 100)
        need = np.where(self.n > 0, np.maximum(1, self.n // 8), 0)
        p = np.minimum(self.n, spare + need)
        doc = np.repeat(np.arange(len(p), dtype=np.int32), p)
        at = np.arange(len(doc)) + np.repeat(self.first[:-1] - (np.cumsum(p) - p), p)
        return at.astype(places(len(self.hash))), doc, p - spare


def chunks_of(docs: DataFrame, chunk_bytes: int, hashes_a_bucket: int) -> tuple[int, int]:
    """(chunks, buckets) for the texts' size."""
    size = total(docs, F.octet_length("text"))
    return max(FEWEST, -(-size // chunk_bytes)), max(FEWEST, -(-size // (16 * hashes_a_bucket)))


def find_sets(docs: DataFrame, words: int, percent: int, chunks: int, buckets: int) -> DataFrame:
    """All rows with their set's size and a number, chunk * 2**32 + place in it; those that may have a partner also with the set's digest.

    The first row of a chunk with a digest carries the set.
    """
    given = dealt(docs.select("doc_id", "text"), chunks)

    def probe(t: pa.Table):
        s = Shingles(t, words)
        at, doc, need = s.probes(percent)
        values, index, local = distinct_with_owners(s.hash[at], doc)
        return s, doc, need, values, index, local

    def ask(t: pa.Table) -> pa.Table:
        return blocks(t.column("chunk")[0].as_py(), probe(t)[3], buckets)

    def decide(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _SETS.empty_table()
        s, doc, need, values, index, local = probe(left)
        shared = (replies(right, 1, values, buckets) | local)[index]
        found = np.bincount(doc, weights=shared, minlength=len(s.n))
        maybe = (found >= need) & (s.n > 0)
        raw: list[bytes | None] = []
        digest: list[bytes | None] = []
        seen: set[bytes] = set()
        for i in s.order.tolist():
            d = hashlib.blake2b(s.hash[s.first[i] : s.first[i + 1]], digest_size=16).digest() if maybe[i] else None
            digest.append(d)
            raw.append(s.hash[s.first[i] : s.first[i + 1]].tobytes() if d and d not in seen else None)
            if d:
                seen.add(d)
        base = left.column("chunk")[0].as_py() << 32
        return pa.table([pa.array(np.arange(len(s.n)) + base), left.column("doc_id").take(pa.array(s.order)), pa.array(s.n[s.order]), pa.array(digest, pa.binary()), pa.array(raw, pa.binary())], schema=_SETS)

    shared = answered(given.groupBy("chunk").applyInArrow(ask, BLOCKS), 1, held_elsewhere)
    return given.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(decide, SETS)


def _sets(t: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("shingles")]


def inverted_lists(classes: DataFrame, percent: int, hashes_a_chunk: int = 1 << 19, hashes_a_bucket: int = 1 << 18) -> DataFrame:
    """Entries (shingle, class) of the shingles by which a class has to be found: the rarest first, so few classes meet in one.

    How many classes hold a shingle is counted over all classes; those that one class alone holds take room in the prefix but give no entry.
    """
    size = total(classes, "n")
    chunks, buckets = max(FEWEST, -(-size // hashes_a_chunk)), max(FEWEST, -(-size // hashes_a_bucket))
    given = chunked(classes.select("rep", "n", "shingles"), chunks, "rep")

    def counted(t: pa.Table):
        sets = _sets(t)
        flat = np.concatenate(sets)
        values, index, counts = np.unique(flat, return_inverse=True, return_counts=True)
        return sets, flat, values, index, counts.astype(np.uint32)

    def ask(t: pa.Table) -> pa.Table:
        _, _, values, _, counts = counted(t)
        return blocks(t.column("chunk")[0].as_py(), values, buckets, counts)

    def rarity(group: np.ndarray, extra: np.ndarray) -> np.ndarray:
        held = np.bincount(group, weights=extra)
        return np.where(held < 2, 0, np.minimum(255, 8 * np.log2(np.maximum(held, 2)))).astype(np.uint8)[group]

    def entries(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _LISTS.empty_table()
        sets, flat, values, index, _ = counted(left)
        rare = replies(right, 1, values, buckets, bits=False)[index]
        sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.lexsort((flat, rare, owner))
        first = np.cumsum(sizes) - sizes
        nth = np.arange(len(flat)) - first[owner]
        prefix = sizes - -(-percent * sizes // 100) + 1
        alone = np.bincount(owner, weights=rare == 0, minlength=len(sets)).astype(np.int64)
        take = (nth < prefix[owner]) & (rare[order] > 0)
        o = owner[take]
        return pa.table(
            [pa.array(flat[order][take].view(np.int64)), pa.array(left.column("rep").to_numpy()[o]), pa.array(sizes[o]), pa.array((sizes - alone)[o]), pa.array(np.maximum(0, prefix - alone)[o]), pa.array(nth[take])], schema=_LISTS
        )

    rare = answered(given.groupBy("chunk").applyInArrow(ask, BLOCKS), 1, rarity, np.uint32)
    return given.groupBy("chunk").cogroup(rare.groupBy("chunk")).applyInArrow(entries, LISTS)


def subset_sizes(n: int, most: int, percent: int) -> list[int]:
    """Sizes of the subsets that a set of n shingles has to show so that it meets every linked set of at most `most`."""
    low, high = least_overlap(n, percent), min(most, 100 * n // percent)
    return sorted({c for b in range(low, high + 1) if (c := pair_overlap(n, b, percent)) <= min(n, b)})


def boundary(lists: DataFrame, classes: DataFrame, percent: int, most: int = 14) -> int:
    """The size up to which showing subsets costs no more rows than scanning lists; 0 if it never does. At most `most` rows reach the driver."""
    held = lists.groupBy("e").agg(F.count("*").alias("k"))
    scan = {int(r[0]): int(r[1]) for r in lists.filter(F.col("n") <= most).join(held, "e").groupBy("n").agg(F.sum("k")).collect()}
    have = {int(r[0]): int(r[1]) for r in classes.filter(F.col("n") <= most).groupBy("n").count().collect()}
    best, at = sum(scan.values()), 0
    for x in range(1, most + 1):
        show = sum(have.get(n, 0) * sum(math.comb(n, c) for c in subset_sizes(n, x, percent)) for n in range(1, x + 1))
        # sets near the boundary are in lists too, for larger partners
        cost = show + sum(scan.get(n, 0) for n in range(least_overlap(x + 1, percent), most + 1))
        if cost <= best:
            best, at = cost, x
    return at


def by_subsets(classes: DataFrame, limit: int, percent: int) -> DataFrame:
    """Links (a, b) among sets of at most `limit` shingles: equal subsets of size c prove an overlap of c.

    Of all that show a subset the smallest set links with whichever it can; any pair that the subset proves is proved through it.
    """
    schema = pa.schema([("key", pa.int64()), ("c", pa.int32()), ("rep", pa.int64()), ("n", pa.int64())])

    def show(batches):
        for batch in batches:
            rows = []
            for rep, n, raw in zip(batch.column("rep").to_pylist(), batch.column("n").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
                s = mix(np.frombuffer(raw, np.uint64), 9).tolist()
                for c in subset_sizes(n, limit, percent):
                    # a sum of mixed hashes names a subset whatever its order
                    rows.extend((((sum(x) + c) % 2**64), c, rep, n) for x in itertools.combinations(s, c))
            if rows:
                k, c, r, n = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(k, np.uint64).view(np.int64)), pa.array(c, pa.int32()), pa.array(r, pa.int64()), pa.array(n, pa.int64())], schema=schema)

    shown = classes.filter(F.col("n") <= limit).select("rep", "n", "shingles").mapInArrow(show, "key long, c int, rep long, n long")
    lead = shown.groupBy("key", "c").agg(F.min(F.struct("n", "rep")).alias("lead"), F.count("*").alias("k")).filter("k > 1")
    met = shown.join(lead, ["key", "c"]).filter((F.col("rep") != F.col("lead.rep")) & (F.lit(percent) * (F.col("n") + F.col("lead.n")) <= (100 + percent) * F.col("c")))
    return met.select(F.col("rep").alias("a"), F.col("lead.rep").alias("b")).distinct()


#: Ids of so many classes are sent out to pick their sets where they lie; for more, all sets go through the join.
MOST_SENT = 1 << 20


def _occurring(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The classes that pairs (a, b) name, picked without moving the others if they are few; else all of them."""
    ids = checkpointed(pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct())
    return classes.join(F.broadcast(ids), "rep", "left_semi") if ids.count() <= MOST_SENT else classes


def verified(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets link."""
    pairs = checkpointed(pairs.select("a", "b"))
    classes = _occurring(pairs, classes)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def test(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], schema=schema).filter(pa.array(keep, pa.bool_()))

    x = classes.select(F.col("rep").alias("a"), F.col("shingles").alias("x"))
    y = classes.select(F.col("rep").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(test, "a long, b long").distinct()


def _possible(percent: int, na, nb, sa, sb) -> object:
    """Whether sets of these sizes, with so many shingles that any other set holds, can link at all."""
    least = F.ceil(F.lit(percent) * (na + nb) / (100 + percent))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (F.least(sa, sb) >= least)


def _pairs(met: DataFrame, percent: int) -> DataFrame:
    """Count in how many lists two classes (a, b) meet, and keep those that can link: what they share beyond the prefixes is bounded."""
    counted = met.groupBy("a", "b").agg(F.count("*").alias("k"), *(F.first(c).alias(c) for c in ("na", "nb", "sa", "sb", "ta", "tb")))
    rest = F.greatest(F.col("sa") - F.col("ta"), F.col("sb") - F.col("tb"))
    return counted.filter(F.col("k") + rest >= F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / (100 + percent)))


def _lead(lists: DataFrame, by: str) -> DataFrame:
    """(e, l) of each list in which different components meet: its first or last entry. A row for each list, written down, so that the join with it can be split where a list is long."""
    lead = lists.groupBy("e").agg(F.expr(f"{by}(struct(comp, rep, n, shared, taken))").alias("l"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    return checkpointed(lead.filter("lo < hi").select("e", "l"))


def _leaders(lists: DataFrame, lead: DataFrame, percent: int) -> DataFrame:
    """For each class the one, among the leaders of its lists and not in its own component, that it meets most often."""
    met = lists.join(lead, "e").filter(F.col("comp") != F.col("l.comp"))
    met = met.select(
        F.col("rep").alias("a"), F.col("l.rep").alias("b"), F.col("n").alias("na"), F.col("l.n").alias("nb"),
        F.col("shared").alias("sa"), F.col("l.shared").alias("sb"), F.col("taken").alias("ta"), F.col("l.taken").alias("tb"),
    ).filter(_possible(percent, F.col("na"), F.col("nb"), F.col("sa"), F.col("sb")))
    return _pairs(met, percent).groupBy("a").agg(F.max(F.struct("k", "b")).alias("best")).select("a", F.col("best.b").alias("b"))


#: Ratio of the sizes at the ends of a size band.
BAND = 1.05


def _band(n) -> object:
    return F.floor(F.log(n.cast("double")) / float(np.log(BAND))).cast("int")


def _candidates(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes of different components that meet in a list and can link, once for each list.

    Sets that link have their first common shingle, in the order of rarity, no further from the start than what they may lack allows: an entry at place pos of a set of n serves only partners of
    at most (n - pos) * (100 + percent) / percent - n shingles. So entries meet by shingle and size band: the smaller set (of equal ones, the first) waits in its own band, the larger one looks
    into those bands whose sizes its entry still serves. Classes that share only what is frequent, as a template, meet in no band.
    """
    serves = F.floor(((F.col("n") - F.col("pos")) * (100 + percent)).cast("double") / percent).cast("long") - F.col("n")
    usable = lists.withColumn("serves", serves)
    x = usable.filter("serves >= n").select("e", _band(F.col("n")).alias("band"), F.col("rep").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"), F.col("shared").alias("sa"), F.col("serves").alias("va"))
    low, high = F.ceil(F.lit(percent) * F.col("n") / 100).cast("long"), F.least("n", "serves")
    y = usable.filter(high >= low).select("e", F.explode(F.sequence(_band(low), _band(high))).alias("band"), F.col("rep").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"), F.col("shared").alias("sb"), F.col("serves").alias("vb"))
    smaller = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    return x.join(y, ["e", "band"]).filter(smaller & (F.col("ca") != F.col("cb")) & (F.col("nb") <= F.col("va")) & (F.col("na") <= F.col("vb")) & _possible(percent, F.col("na"), F.col("nb"), F.col("sa"), F.col("sb"))).select("a", "b")


def _all_across(lists: DataFrame, percent: int) -> DataFrame:
    """All pairs that meet in a list, lie in different components and can link."""
    return _candidates(lists, percent).distinct()


def _with_component(lists: DataFrame, comp: DataFrame) -> DataFrame:
    """The entries of lists, each with its class's component."""
    own = lists.drop("comp").join(comp.select(F.col("id").alias("rep"), F.col("component").alias("comp")), "rep", "left")
    return checkpointed(own.withColumn("comp", F.coalesce("comp", "rep")))


def link(classes: DataFrame, percent: int, rounds: tuple[str, ...]) -> DataFrame:
    """(id, component) of the classes (rep, n, shingles) that link with others, as connected() gives it."""
    lists = checkpointed(inverted_lists(classes, percent).withColumn("comp", F.col("rep")))
    limit = boundary(lists, classes, percent)
    comp = connected(by_subsets(classes, limit, percent))
    lists = lists.filter(F.col("n") >= least_overlap(limit + 1, percent))
    alone = comp.isEmpty()  # then each class is its own component, as the lists say already
    # each class first meets one leader of its lists; after that few lists still hold different components
    for by in (*rounds, None):
        if not alone:
            lists = _with_component(lists, comp)
        lead = _lead(lists, by or "min")
        if lead.isEmpty():
            break
        pairs = _leaders(lists, lead, percent) if by else _all_across(checkpointed(lists.join(lead.select("e"), "e", "left_semi")), percent)
        more = checkpointed(verified(pairs, classes, percent))
        if by is None or not more.isEmpty():
            # what is known already is a star for each component
            links = comp.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more)
            comp, alone = connected(links), False
            lists = lists.join(lead.select("e"), "e", "left_semi")
    return comp


def _rows(given: DataFrame, words: int, percent: int, chunks: int, buckets: int, rounds: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets of all rows, those with a digest, (digest, low, first_id, component) of each class that may have partners): low is the smallest id of its component, first_id its own."""
    sets = checkpointed(find_sets(given, words, percent, chunks, buckets))
    release(given.sparkSession)  # the texts that were dealt
    maybe = sets.filter("digest is not null")
    same = maybe.groupBy("digest").agg(F.min("row").alias("row"), F.min("doc_id").alias("first_id"))
    # a class is named by its smallest id, so that it leads its lists; where another class has that name or there is none, by its row
    owner = same.groupBy("first_id").agg(F.min("row").alias("owner"))
    named = same.join(owner, "first_id", "left").withColumn("rep", F.when(F.col("row") == F.col("owner"), F.col("first_id")).otherwise(-F.col("row") - 2**62))
    to_class = checkpointed(named.select("digest", "row", "first_id", "rep"))
    carriers = maybe.filter("shingles is not null").select("digest", "row", F.col("n_shingles").alias("n"), "shingles")
    classes = checkpointed(carriers.join(to_class.select("digest", "row", "rep"), ["digest", "row"]).select("rep", "n", "shingles"))
    comp = link(classes, percent, rounds).select(F.col("id").alias("rep"), "component")
    release(given.sparkSession)  # the lists
    own = to_class.join(comp, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    low = own.groupBy("component").agg(F.min("first_id").alias("low"))
    return sets, maybe, own.join(low, "component").select("digest", "low", "first_id", "component")


def join(docs: DataFrame, words: int = 5, percent: int = 75, chunk_bytes: int = 4 << 20, hashes_a_bucket: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text", rounds: tuple[str, ...] = ("min", "max")) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and class_id.

    Texts are lower-cased (A-Z); a set holds the distinct spans of `words` words, or the whole sequence if there are fewer. Documents
    link when 100 * intersection >= percent * union, and a component is what links reach; its id is the smallest of its documents' ids. Equal sets are one class, whose id is
    that of its smallest document. Sets up to a size boundary, chosen by the rows that either way costs, meet by equal subsets; larger ones by inverted lists of their rarest shingles.
    In lists, classes first link with one leader each; after that only pairs of different components are looked at, so a group of copies costs
    a few rows per member, and no link between components is missed. A null text is empty; texts without words link with nothing. Each row is a document of its own: rows
    with one id but different texts do not link by their id. A row without an id links as others do; its component has the smallest id that there is in it, or null.
    An empty table gives no rows; other columns are dropped.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets, maybe, own = _rows(given, words, percent, *chunks_of(given, chunk_bytes, hashes_a_bucket), rounds)
    several = maybe.select("doc_id", "n_shingles", "digest").join(own, "digest").select("doc_id", "n_shingles", F.col("low").alias("component_id"), F.col("first_id").alias("class_id"))
    alone = sets.filter("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"))
    return several.unionByName(alone)


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 75, chunk_bytes: int = 4 << 20, hashes_a_bucket: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text", rounds: tuple[str, ...] = ("min", "max")) -> DataFrame:
    """One document of each component of join(), that with the smallest id, in the input's columns; see there for null and repeated ids.

    Of rows that are equal in id and text one stays; texts without words all stay. The texts move twice: once to be compared, once to leave out what goes.
    """
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"_{c}") for c in rest))
    given = whole.select("doc_id", "text")
    chunks, buckets = chunks_of(given, chunk_bytes, hashes_a_bucket)
    _, maybe, own = _rows(given, words, percent, chunks, buckets, rounds)
    rows = checkpointed(maybe.select("row", "doc_id", "digest").join(own.select("digest", "low", "component"), "digest"))
    stays = checkpointed(rows.filter(F.col("doc_id").eqNullSafe(F.col("low"))).groupBy("component").agg(F.min("row").alias("stays")))
    goes = rows.join(stays, "component").filter(F.col("row") != F.col("stays"))
    goes = goes.select(F.shiftright("row", 32).cast("int").alias("chunk"), F.col("row").bitwiseAND(F.lit(2**32 - 1)).cast("long").alias("place"))
    schema = whole.schema

    def leave_out(left: pa.Table, right: pa.Table) -> pa.Table:
        keep = np.ones(left.num_rows, bool)
        if left.num_rows:
            keep[row_order(left)[right.column("place").to_numpy()]] = False
        return left.select(schema.names).filter(pa.array(keep))

    out = dealt(whole, chunks).groupBy("chunk").cogroup(goes.groupBy("chunk")).applyInArrow(leave_out, schema)
    names = {id_col: "doc_id", text_col: "text"} | {c: f"_{c}" for c in rest}
    return out.select(*(F.col(names[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))
