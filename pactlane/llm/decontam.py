"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, semi_by_id, table, without_ids, written

#: Upper size (distinct shingles) of the size partitions; larger items are in a partition of their own size's power of two.
SMALLEST_PARTITION = 8

_BLANKS = " \t\n\x0b\f\r"


def _words(text: Column) -> Column:
    """Lower-cased words between ASCII white space; null and wordless texts: an array without words."""
    w = F.split(F.btrim(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(_BLANKS)), r"[\x20\x09-\x0D]+")
    return F.when(F.element_at(w, 1) == "", F.array().cast("array<string>")).otherwise(w)


def _windows(rows: DataFrame, k: int, make: str, whole: str) -> Column:
    """Array of make (SQL over w and i) for every window of k words of w; fewer words: whole; none: empty."""
    n = F.size("w")
    return F.when(n >= k, F.expr(f"transform(sequence(0, size(w) - {k}), i -> {make})")).when(n > 0, F.expr(f"array({whole})")).otherwise(F.expr(f"slice(array({whole}), 1, 0)"))


def _shingle_strings(rows: DataFrame, k: int) -> Column:
    return _windows(rows, k, "concat_ws(' ', " + ", ".join(f"w[i + {j}]" for j in range(k)) + ")", "concat_ws(' ', w)")


def _shingle_hashes(rows: DataFrame, k: int) -> Column:
    return _windows(rows, k, "xxhash64(" + ", ".join(f"w[i + {j}]" for j in range(k)) + ")", "xxhash64(concat_ws(' ', w))")


def sketches(items: DataFrame, threshold: float, words: int) -> DataFrame:
    """(item, n, need, hash) rows: bottom-m MinHash sketches of the items, m set by size partition.

    Items are partitioned by their number n of distinct shingles with upper size u. An item contained
    to the threshold lacks at most floor((1 - threshold) * n) shingles, so a partition's sketches hold
    the m = 2 * floor((1 - threshold) * u) + 1 least hashes and a containing document shares at least
    need = min(m, n) - floor((1 - threshold) * n) of them: the search misses nothing.
    """
    rows = items.withColumn("w", _words(F.col("text")))
    hashed = rows.withColumn("h", F.array_sort(F.array_distinct(_shingle_hashes(rows, words)))).withColumn("n", F.size("h")).where("n > 0")
    upper = F.pow(2.0, F.ceil(F.log2(F.greatest(F.col("n"), F.lit(SMALLEST_PARTITION)).cast("double"))))
    lacking = lambda size: F.floor((1 - threshold) * size + 1e-9).cast("int")
    sized = hashed.withColumn("m", 2 * lacking(upper) + 1)
    need = F.least("m", "n") - lacking(F.col("n"))
    return sized.select("item", "n", F.greatest(need, F.lit(1)).alias("need"), F.explode(F.expr("slice(h, 1, m)")).alias("hash"))


def _bounded(small: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(small) if rows <= BROADCAST_ROWS else small


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", words: int = 5, threshold: float = 0.8) -> DataFrame:
    """(id, item, n_shared, n_item, containment) of every item that a document holds to the threshold.

    Containment is the share of an item's distinct word shingles that the document has. Candidates
    come from the items' MinHash sketches, which every shingle of every document is looked up in;
    each candidate is verified on the shingles themselves. Sketches and item shingles are broadcast
    only when counted as few, else joined by shuffle; candidates are aggregated by document and item.

    A text of fewer words than a shingle is one shingle; a null or wordless document holds nothing and
    such an item is in nothing. Rows of equal id are judged one by one and reported once an item, with
    the largest share; rows with a null id are left out, and items with a null id are kept as null.
    Other columns are left out. Empty tables give no rows.
    """
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    tests = items.select(F.struct(F.col(item_col).alias("i")).alias("item"), F.col(item_text).cast("string").alias("text"))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    sketch = written(sketches(tests, threshold, words), "sketches")
    split = rows.withColumn("w", _words(F.col("text"))).withColumn("row", F.monotonically_increasing_id())
    seen = split.select("id", "row", F.explode(_shingle_hashes(split, words)).alias("hash"))
    hits = seen.join(_bounded(sketch, sketch.count()), "hash").groupBy("id", "row", "item", "need").agg(F.count_distinct("hash").alias("got"))
    candidates = written(hits.where("got >= need").select("id", "item").distinct(), "candidates")

    ids = candidates.select("id").distinct()
    shingled = tests.withColumn("w", _words(F.col("text")))
    of_item = written(shingled.select("item", F.explode(F.array_distinct(_shingle_strings(shingled, words))).alias("s")).distinct(), "item-shingles")
    sizes = of_item.groupBy("item").agg(F.count("*").alias("n_item"))
    some = semi_by_id(rows, ids, "id", ids.count()).withColumn("w", _words(F.col("text"))).withColumn("row", F.monotonically_increasing_id())
    pairs = some.select("id", "row", F.explode(F.array_distinct(_shingle_strings(some, words))).alias("s")).join(_bounded(of_item, of_item.count()), "s")
    shared = pairs.groupBy("id", "row", "item").agg(F.count("*").alias("n_shared")).groupBy("id", "item").agg(F.max("n_shared").alias("n_shared"))
    exact = shared.join(candidates, ["id", "item"], "left_semi").join(sizes, "item").withColumn("containment", F.col("n_shared") / F.col("n_item"))
    return exact.where(F.col("containment") >= threshold).select(
        F.col("id").cast(id_type).alias(id_col), F.col("item.i").cast(item_type).alias(item_col if item_col != id_col else "item"), "n_shared", "n_item", "containment"
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs without those that hold an item to the threshold, all columns kept; rows with a null id stay."""
    found = written(contained(docs, items, id_col, text_col, words=words, threshold=threshold).select(id_col).distinct(), "contaminated")
    return without_ids(docs, found, id_col)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                              WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
bs AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM b),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
p AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, CAST(n_shared AS DOUBLE) / n_item AS containment
FROM p JOIN n USING (item_id) WHERE CAST(n_shared AS DOUBLE) / n_item >= 0.8
"""
