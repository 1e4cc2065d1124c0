"""Exact near-duplicate links by word-shingle Jaccard similarity: prefix filter over shingles in rarest-first order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_PARTS, grouped, lookup, semi_by_id, ship, slices, written
from .graph import components
from .simhash import fingerprint, hamming_links
from .textstats import Rolling, spans

#: Least similarity as a fraction, so that bounds are whole numbers.
NUM, DEN = 4, 5

#: Documents on which common shingles are looked for, and how many of these are put last. They order the prefixes only; results don't depend on them.
SAMPLE_DOCS, COMMON, COMMON_LEAST = 10_000, 20_000, 3

#: Texts of one shingle that a task compares at once (longer lists are compared block by block), and pairs that a worker makes at once.
LIST_ROWS, BLOCK = 2_000, 1 << 20

#: Bytes of a sketch that travels with the rows of a list, at most; wider ones are folded.
WIDEST = 512

_K = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingles(texts: list[str | None], words: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles (lower-cased, ASCII white space splits).

    Fewer words than a shingle: the whole sequence; no word: none.
    """
    w = spans(pa.array([t.lower() if t else t for t in texts], pa.string()))
    h = Rolling(w.data).hashes(w.at, w.lengths)
    out, first = [], 0
    whole = np.full(max(len(h) - words + 1, 0), words, np.uint64)
    for j in range(words if len(whole) else 0):
        whole = whole * _K + h[j : len(h) - words + 1 + j]
    whole = _mixed(whole)
    for n in np.bincount(w.doc, minlength=w.n).tolist():
        if n >= words:
            out.append(np.unique(whole[first : first + n - words + 1]))
        else:
            one = np.full(min(n, 1), n, np.uint64)
            for x in h[first : first + n]:
                one = one * _K + x
            out.append(_mixed(one))
        first += n
    return out


def signature(s: np.ndarray) -> np.uint64:
    """64-bit signature of a set of shingles; 0 for none."""
    if not len(s):
        return np.uint64(0)
    return _mixed(s.sum(keepdims=True) * _K + np.bitwise_xor.reduce(_mixed(s + _K), keepdims=True))[0]


def sketch(s: np.ndarray) -> bytes:
    """Whether the number of shingles in each bin (by their low bits) is odd, a bit each; at least as many bins as shingles. Empty for no shingle."""
    if not len(s):
        return b""
    bins = 1 << max(6, len(s).bit_length())
    n = np.bincount((s & np.uint64(bins - 1)).astype(np.int64), minlength=bins)
    return np.packbits((n & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(x: bytes, size: int) -> np.ndarray:
    """The sketch of the same set in as many bytes at most, as 64-bit words."""
    words = np.frombuffer(x, np.uint64)
    return np.bitwise_xor.reduce(words.reshape(-1, size // 8), axis=0) if len(x) > size else words


def least_apart(sketches: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lower bound, from the sketches, of the shingles that only one of the sets i and j holds, for each pair of places."""
    size = np.fromiter(map(len, sketches), np.int64, len(sketches))
    narrow = np.minimum(size[i], size[j])
    out = np.zeros(len(i), np.int64)
    for w in np.unique(narrow[narrow > 0]).tolist():
        at = np.flatnonzero(narrow == w)
        rows, code = np.unique(np.concatenate([i[at], j[at]]), return_inverse=True)
        bits = np.stack([folded(sketches[r], w) for r in rows.tolist()])
        a, b = code[: len(at)], code[len(at) :]
        for k in range(0, len(at), step := max(1, (4 << 20) // w)):
            out[at[k : k + step]] = np.bitwise_count(bits[a[k : k + step]] ^ bits[b[k : k + step]]).sum(axis=1, dtype=np.int64)
    return out


def _reachable(apart: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Whether sets of both shingles together, of which at least apart are in one only, may have the similarity."""
    return (both - apart) * (NUM + DEN) >= 2 * NUM * both


def prefix(s: np.ndarray, common: tuple[np.ndarray, np.ndarray] | tuple[()]) -> np.ndarray:
    """The shingles of which two sets at the similarity surely share one: floor(n / 5) + 1 of n.

    common: (places in order of frequency, most frequent first, of some shingles; these shingles, sorted); they come last.
    """
    if not len(s):
        return s
    wanted = len(s) - -(-len(s) * NUM // DEN) + 1
    if len(common):
        order, ordered = common
        at = np.minimum(np.searchsorted(ordered, s), len(ordered) - 1)
        seen = np.flatnonzero(ordered[at] == s)
        if len(seen):
            last = s[seen][np.argsort(-order[at[seen]], kind="stable")]
            s = np.concatenate([np.delete(s, seen), last])
    return s[:wanted]


def _common(docs: DataFrame, total: int, words: int) -> tuple[np.ndarray, np.ndarray] | tuple[()]:
    """Shingles that several of a bounded sample of documents hold, most frequent first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            found = shingles(b.column("text").to_pylist(), words)
            h, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], ["h", "n"])

    parts = max(1, -(-total // SAMPLE_DOCS))
    some = docs.where(F.pmod(F.xxhash64("row"), F.lit(parts)) == 0).select("text")
    counts = some.mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_LEAST)
    found = counts.orderBy(F.desc("n"), "h").limit(COMMON).select("h").toArrow().column("h").to_numpy().view(np.uint64)
    order = np.argsort(found)
    return (order, found[order]) if len(found) else ()


def _profiles(docs: DataFrame, common: tuple, words: int, simhash_words: int) -> DataFrame:
    """(row, id, fp, sig, n, sketch, prefix) of every row of docs (row, id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            texts = b.column("text").to_pylist()
            fp = np.array([fingerprint(t, simhash_words) for t in texts], np.uint64)
            sets = shingles(texts, words)
            sig = np.array([signature(s) for s in sets], np.uint64)
            heads = [prefix(s, common) for s in sets]
            ends = np.cumsum([0, *map(len, heads)]).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(heads).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("id"), pa.array(fp.view(np.int64)), pa.array(sig.view(np.int64)), pa.array([len(s) for s in sets], pa.int32()), pa.array([sketch(s) for s in sets], pa.binary()), flat],
                ["row", "id", "fp", "sig", "n", "sketch", "prefix"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("row", "id", "text").mapInArrow(run, f"row bigint, id {kind}, fp bigint, sig bigint, n int, sketch binary, prefix array<bigint>")


def _allowed(n: Column, pos: Column, n2: Column, pos2: Column) -> Column:
    """Whether sizes and places of a shared shingle in the order allow the similarity."""
    most = F.least(pos, pos2) + F.least(n - pos, n2 - pos2)
    return (most * (NUM + DEN) >= NUM * (n + n2)) & (F.greatest(n, n2) * NUM <= F.least(n, n2) * DEN)


def _lists(nodes: DataFrame) -> DataFrame:
    """(key, n, sig, pos, sig2, n2, pos2): texts of each prefix shingle that more than one has, with the text before each in order of size.

    Rows are sorted over all tasks by shingle and size, so a shingle of very many texts is spread over
    as many tasks as it needs. A list that lies on the edge of two tasks keeps its rows, whatever their number.
    """
    columns = ["key", "n", "sig", "pos"]
    postings = nodes.select("sig", "n", F.posexplode("prefix").alias("pos", "key")).select(*columns)
    ordered = postings.repartitionByRange("key", "n", "sig").sortWithinPartitions("key", "n", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before = None, None  # the row that waits for its follower, and the one before it
        for b in batches:
            if not b.num_rows:
                continue
            now = [b.column(c).to_numpy() for c in columns]
            if last is not None:
                now = [np.concatenate([x, y]) for x, y in zip(last, now)]
            key = now[0]
            same = np.concatenate([[before is not None and before[0] == key[0]], key[1:] == key[:-1]])
            edge = np.zeros(len(key), bool)
            edge[0] = before is None
            kept = (same | edge)[:-1] | same[1:]
            yield out(now, before, same, np.flatnonzero(kept))
            last, before = [x[-1:] for x in now], [x[-2] for x in now] if len(key) > 1 else before
        if last is not None:
            yield out(last, before, np.array([before is not None and before[0] == last[0][0]]), np.zeros(1, np.int64))

    def out(now: list[np.ndarray], before: list | None, same: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        first = [now[k][:1] if before is None else np.array([before[k]], now[k].dtype) for k in range(4)]
        prev = [np.concatenate([f, x[:-1]])[at] for f, x in zip(first, now)]
        none = ~same[at]
        arrays = [x[at] for x in now]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays] + [pa.array(prev[k], mask=none) for k in (2, 1, 3)], [*columns, "sig2", "n2", "pos2"])

    return ordered.mapInArrow(run, "key bigint, n int, sig bigint, pos int, sig2 bigint, n2 int, pos2 int")


def _pair(u: str, v: str) -> list[Column]:
    return [F.least(u, v).alias("u"), F.greatest(u, v).alias("v")]


def _runs(group: np.ndarray, n: np.ndarray, pos: np.ndarray, root: np.ndarray, part: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of each group that sizes and places in the order allow, in blocks.

    Rows of one root make no pair, nor do rows of one part; part is -1 where all rows of a group are compared.
    """
    order = np.lexsort((n, group))
    group, n, pos, root, part = (x[order].astype(np.int64) for x in (group, n, pos, root, part))
    # Partners of i are the rows after it in its group of at most 5/4 its size.
    wide = (group << 32) + n
    many = np.searchsorted(wide, (group << 32) + n * DEN // NUM, side="right") - np.arange(len(n)) - 1
    k = 0
    while k < len(n):
        sums = np.cumsum(many[k : k + BLOCK])
        take = max(1, int(np.searchsorted(sums, BLOCK, side="right")))
        own = np.arange(k, min(k + take, len(n)))
        k += take
        i = np.repeat(own, many[own])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(many[own]) - many[own], many[own])
        most = np.minimum(pos[i], pos[j]) + np.minimum(n[i] - pos[i], n[j] - pos[j])
        ok = (root[i] != root[j]) & ((part[i] < 0) | (part[i] != part[j])) & (most * (NUM + DEN) >= NUM * (n[i] + n[j]))
        if ok.any():
            yield order[i[ok]], order[j[ok]]


def _across(lists: DataFrame, roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct pairs (u, v) of signatures of different components that neither the prefix filter nor their sketches can tell apart.

    Lists of one component are done. A list of more than LIST_ROWS texts is cut into blocks, and each
    two blocks of it are compared on their own. Rows of the other lists carry their sketches, so that
    the pairs of a passage that many texts share are ruled out where they are made: what is written
    and moved follows the rows of the lists, not their pairs.
    """

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("sig"), pa.array([folded(x, WIDEST).tobytes() for x in b.column("sketch").to_pylist()], pa.binary())], ["sig", "sketch"])

    rooted = lists.select("key", "n", "sig", "pos").join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    rooted = written(rooted, "lists")
    spread = rooted.groupBy("key").agg(F.count("*").alias("rows"), F.min("root").alias("one"), F.max("root").alias("other")).where("one != other")
    total = rooted.count()
    open_ = spread.select("key", F.ceil(F.col("rows") / LIST_ROWS).cast("int").alias("blocks"), (F.col("rows") * HOT_PARTS > total).alias("hot"))
    own = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("sig"), F.col("blocks"))).otherwise(0).cast("int")
    sketches = nodes.where("n > 0").select("sig", "sketch").mapInArrow(small, "sig bigint, sketch binary")
    met = lookup(rooted, open_, "key", "hot").join(sketches, "sig").withColumn("part", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    cells = met.select("key", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "n", "sig", "pos", "root", "part", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in grouped(batches, ["key", "a", "b"]):
            n, sig, pos, root, part, a, b = (t.column(c).to_numpy() for c in ("n", "sig", "pos", "root", "part", "a", "b"))
            sketches = t.column("sketch").to_pylist()
            for i, j in _runs(group, n, pos, root, np.where(a == b, -1, part)):
                near = _reachable(least_apart(sketches, i, j), n[i].astype(np.int64) + n[j])
                i, j = i[near], j[near]
                p = np.unique(np.stack([np.minimum(sig[i], sig[j]), np.maximum(sig[i], sig[j])], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy())], ["u", "v"])

    return cells.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(run, "u bigint, v bigint").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """The pairs that reach the similarity: by sketches those that can't go first, the others by all shingles of one row of each signature."""

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.arange(b.num_rows)
            apart = least_apart(b.column("x").to_pylist() + b.column("y").to_pylist(), at, at + b.num_rows)
            yield b.filter(pa.array(_reachable(apart, b.column("n").to_numpy().astype(np.int64)))).select(["u", "v"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            found = shingles(b.column("text").to_pylist(), words)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([s.tobytes() for s in found], pa.binary())], ["row", "s"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("x"), b.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both * (NUM + DEN) >= NUM * (len(x) + len(y)))
            yield b.filter(pa.array(ok, pa.bool_())).select(["u", "v"])

    def beside(pairs: DataFrame, of: DataFrame, *columns: str) -> DataFrame:
        side = lambda u, x: of.select(F.col("sig").alias(u), *(F.col(c).alias(c[0] + x) for c in columns)).hint("shuffle_hash")
        return pairs.join(side("u", "x"), "u").join(side("v", "y"), "v")

    sized = beside(pairs, nodes, "sketch", "n").select("u", "v", F.col("sx").alias("x"), F.col("sy").alias("y"), (F.col("nx") + F.col("ny")).alias("n"))
    left = written(sized.mapInArrow(possible, "u bigint, v bigint"), "pairs")
    asked = left.select(F.explode(F.array("u", "v")).alias("sig")).distinct()
    reps = written(nodes.select("sig", "row").join(asked, "sig", "left_semi"), "representatives")
    held = semi_by_id(docs, reps.select("row"), "row", reps.count()).select("row", "text").mapInArrow(sets, "row bigint, s binary")
    of = written(held.join(reps, "row").select("sig", "s"), "shingles")
    return beside(left, of, "s").select("u", "v", F.col("sx").alias("x"), F.col("sy").alias("y")).mapInArrow(compare, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, simhash_words: int = 3, max_bits: int = 3) -> DataFrame:
    """One row a document: id and component_id (least id reachable over links).

    Two texts are linked if their SimHash fingerprints are within max_bits, or if the Jaccard similarity
    of their sets of word shingles is 0.8 or more. The second search misses no pair: sets at the
    similarity share a shingle among the first floor(n / 5) + 1 of n in any common order; shingles
    that a sample shows as common come last in it. Texts that share one are first compared with their neighbours in
    size only; what that and SimHash tie is one component, and only texts of different components are then
    compared with each other, so a group of many near copies costs few pairs. Pairs that size, the place in the order
    and a small sketch allow are verified on all shingles, as 64-bit hashes. Texts of equal sets are one node.
    Texts of different components that share a shingle in their prefixes and are of like size do have their sketches
    compared pair by pair, but in memory: only pairs near the similarity are written.

    Nulls: a null or wordless text has no shingle and fingerprint 0, by which it is linked; a null id
    stays and never becomes a component id (null only if no id of its component is known). Repeated
    rows stay. An empty table gives an empty result. Other columns are left out.
    """
    ship(docs.sparkSession)
    source = written(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id()), "texts")
    total = source.count()
    common = _common(source, total, words)
    profiles = written(_profiles(source, common, words, simhash_words), "profiles")
    nodes = written(profiles.groupBy("sig").agg(F.min("id").alias("least"), F.count("*").alias("rows"), F.min("row").alias("row"), *(F.first(c).alias(c) for c in ("n", "sketch", "prefix"))), "nodes")
    both = written(profiles.select("sig", "fp").distinct(), "fingerprints")
    classes = written(both.groupBy("fp").agg(F.min("sig").alias("node"), F.count("*").alias("sigs")), "classes")
    node = lambda side: classes.select(F.col("fp").alias(side), F.col("node").alias(f"{side}_node"))
    n_both = both.count()
    of_class = lookup(both, classes.select("fp", "node", (F.col("sigs") * HOT_PARTS > n_both).alias("hot")), "fp", "hot")
    alike = of_class.where("sig != node").select(F.col("sig").alias("u"), F.col("node").alias("v"))
    close = hamming_links(classes.select("fp"), "fp", max_bits).join(node("u"), "u").join(node("v"), "v").select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))
    lists = written(_lists(nodes), "postings")
    beside = lists.where(F.col("sig2").isNotNull() & (F.col("sig") != F.col("sig2")) & _allowed(*map(F.col, ("n", "pos", "n2", "pos2")))).select(*_pair("sig", "sig2")).distinct()
    first = components(alike.unionByName(close).unionByName(_verified(written(beside, "neighbours"), source, nodes, words)))
    more = _verified(written(_across(lists, first, nodes), "candidates"), source, nodes, words)
    roots = components(first.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))
    linked = nodes.select("sig", "least", "rows").join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    members = written(linked, "members")
    n_members = members.count()
    least = members.groupBy("root").agg(F.min("least").alias("component_id"), (F.count("*") * HOT_PARTS > n_members).alias("hot"))
    by_sig = written(lookup(members, least, "root", "hot").select("sig", "component_id", (F.col("rows") * HOT_PARTS > total).alias("hot")), "classes")
    return lookup(profiles.select("id", "sig"), by_sig, "sig", "hot").select(F.col("id").alias(id_col), "component_id")
