"""SimHash near-duplicates by multi-index hashing over two 32-bit halves of the fingerprint."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HOT_PARTS, lookup, semi_by_id, ship, slices, table, without_ids, written
from .graph import components

SEED = 42


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text (A-Z lower-cased, ASCII white space splits).

    Every shingle occurrence votes; fewer words than a shingle: the whole sequence; no word: 0.
    """
    w = text.encode().lower().split() if text else []
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) > words else [b" ".join(w)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), 8192):
        votes += np.unpackbits(h[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One row a document: id and fp (signed 64-bit). Null and wordless texts get 0; other columns are left out."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fp = np.array([fingerprint(t, words) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fp.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def hamming_links(classes: DataFrame, fp: str = "fp", max_bits: int = 3) -> DataFrame:
    """Pairs (u, v) of different fingerprints within max_bits (0 to 3) of one another, each once.

    Of two fingerprints at most three bits apart, one 32-bit half differs in at most one bit. Each
    fingerprint enters both half tables; it probes each with its own half and with every half that
    sets one of its zero bits (the pair's other side has the complementary view, so a ball's other
    part is never needed). Matches are verified over all 64 bits before they leave the join.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("max_bits must be 0 to 3 for halves with balls of radius 1")
    f = F.col(fp)
    halves = F.array(F.struct(F.lit(0).cast("tinyint").alias("seg"), F.shiftrightunsigned(f, 32).alias("half")), F.struct(F.lit(1).cast("tinyint").alias("seg"), f.bitwiseAND(0xFFFFFFFF).alias("half")))
    base = classes.select(f.alias("fp"), F.explode(halves).alias("h")).select("fp", "h.seg", "h.half")
    index = base.select(F.col("fp").alias("v"), "seg", F.col("half").alias("key"))
    one = F.array(*[F.lit(1 << j).cast("bigint") for j in range(32)])
    ball = F.filter(one, lambda bit: F.col("half").bitwiseAND(bit) == 0)
    probe = base.select(F.col("fp").alias("u"), "seg", F.explode(F.concat(F.array(F.lit(0).cast("bigint")), ball)).alias("bit"), "half").select(
        "u", "seg", F.col("half").bitwiseOR(F.col("bit")).alias("key"), (F.col("bit") == 0).alias("same")
    )
    apart = F.col("u").bitwiseXOR(F.col("v"))
    # Neither side may be broadcast: the ball makes 33 rows of one, which size estimates do not see.
    found = probe.join(index.hint("merge"), ["seg", "key"]).where(
        (F.col("u") != F.col("v")) & (~F.col("same") | (F.col("u") < F.col("v"))) & (F.bit_count(apart) <= max_bits)
        # A pair that the first half already finds is left to it.
        & ((F.col("seg") == 0) | (F.bit_count(F.shiftrightunsigned(apart, 32)) > 1))
    )
    return found.select("u", "v")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 3) -> DataFrame:
    """One row a document: id, fp, component_id (least id reachable over links), n_class (rows with its fingerprint).

    Equal fingerprints form a class first, so thousands of copies cost one row in the search. Links
    between classes become components by star contraction on written tables. A fingerprint with over
    a thousandth of all rows, and a component with over a thousandth of all fingerprints, is resolved
    by a broadcast of at most a thousand such rows.

    Nulls: a null text counts as empty (fingerprint 0, linked like any other); a null id stays and
    never becomes a component id (null only if no id of its component is known). Repeated rows stay.
    An empty table gives an empty result.
    """
    fps = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "classes")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    roots = components(hamming_links(classes, "fp", max_bits))
    linked = written(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "linked")
    n_classes = linked.count()
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"), (F.count("*") * HOT_PARTS > n_classes).alias("hot"))
    by_fp = written(lookup(linked, least, "root", "hot").select("fp", "component_id", F.col("n").alias("n_class"), (F.col("n") * HOT_PARTS > total).alias("hot")), "members")
    out = lookup(fps, by_fp, "fp", "hot")
    return out.select(F.col("id").alias(id_col), "fp", "component_id", "n_class")


def one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 3, found: DataFrame | None = None) -> DataFrame:
    """docs with one document of each near-duplicate group, that of the least id, and all its columns.

    found: the groups (id, component_id) if they are known; else those of near_duplicates.

    Documents are told apart by id, so rows with a null id stay. Rows that share an id are one
    document and one of them stays (the least text). The ids to drop are broadcast only when counted
    as few; only rows of shared ids are ever grouped.
    """
    found = near_duplicates(docs, id_col, text_col, words, max_bits) if found is None else found
    groups = written(found.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), "component_id"), "groups")
    leaders = groups.groupBy("_id").agg(F.bool_or(F.col("_id") == F.col("component_id")).alias("leads"), F.count("*").alias("rows"))
    state = written(leaders.where("not leads or rows > 1"), "decisions")
    kept = without_ids(docs, state.where("not leads").select(F.col("_id").alias(id_col)), id_col)
    shared = state.where("leads and rows > 1").select(F.col("_id").alias(id_col))
    n = shared.count()
    if not n:
        return kept
    order = Window.partitionBy(id_col).orderBy(text_col)
    turn = "turn"
    while turn in kept.columns:
        turn += "_"
    again = semi_by_id(kept, shared, id_col, n).withColumn(turn, F.row_number().over(order)).where(F.col(turn) == 1).select(*(F.col(f"`{c}`") for c in kept.columns))
    return without_ids(kept, shared, id_col).unionByName(again)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = near_duplicates(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_class")
