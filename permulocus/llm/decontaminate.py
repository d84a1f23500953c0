"""Operator 2, benchmark decontamination: size-partitioned MinHash containment search. DataFrame functions only.

A text is the set of its shingles of five words (letters and digits, lower-cased). An item is contained in a document
if at least 0.8 of the item's shingles are in the document, however long that is.

Search: items are partitioned by their number of shingles, in powers of two. A partition's sketch width is one more than the
shingles that its largest item may lack, and an item's sketch is that many of its smallest hashes (bottom-k MinHash).
By the pigeonhole principle a containing document holds some hash of the sketch, so no pair is lost, whatever the sizes.
A document asks only partitions whose smallest item it is long enough to contain, each with those of its hashes that the partition's
filter lets pass: a bitmap of FILTER_ROOM bits a sketched hash, FILTER_BITS at most. Beyond that, more hashes pass, and the join decides all the same.
Verification is by pair: a candidate pair's item brings its shingles, the document those of its own that pass the filter of all items' shingles,
and what they share is counted. A shingle of many items makes no rows.

The driver holds the filters alone, of at most FILTER_BITS bits each, one a partition (31 at most) and two of all. Broadcast are sketches, item shingles
and candidates only where their values take at most BROADCAST_BYTES; beyond, they are joined by shuffle. A passage in very many documents
makes one row a document, never pairs of documents.

Cases: texts of fewer words are one shingle, the whole text; null or empty texts have none and match nothing; items of equal
shingles match alike; an item id on several texts is one item each, and the most contained counts; repeated rows are one document;
rows with a null id are searched like others; empty tables give no pairs; columns of documents may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, shingle_hashes, shingle_texts, small, stage, table

SHINGLE = 5
CONTAINED = 0.8
FILTER_ROOM = 64
FILTER_BITS = 1 << 20


def plain_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _may_lack(n: Column, share: float) -> Column:
    return n - F.ceil(F.lit(share) * n - F.lit(1e-9)).cast("int")


def _filter(hashes: DataFrame) -> list[int]:
    """A bitmap of column h in words of 64 bits, a power of two in number; bit i is set where a hash ends in i."""
    bits, wanted = 64, min(FILTER_BITS, FILTER_ROOM * hashes.count())
    while bits < wanted:
        bits *= 2
    slot = F.col("h").bitwiseAND(bits - 1)
    one = F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")
    rows = hashes.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(one).alias("word")).collect()
    words = [0] * (bits // 64)
    for r in rows:
        words[r["at"]] = r["word"]
    return words


def _passes(h: Column, words: list[int]) -> Column:
    bits = F.split(F.lit(" ".join(map(str, words))), " ").cast("array<bigint>")  # folded to one constant
    slot = h.bitwiseAND(64 * len(words) - 1)
    return F.getbit(F.get(bits, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(63).cast("int")) == 1


def sketched(items: DataFrame, share: float = CONTAINED, shingle: int = SHINGLE) -> DataFrame:
    """Staged rows (item, item_id, n, upper, width, least_hits, h, s) of items with a shingle; upper names the size partition, s are the shingles, one a line."""
    out = items.select("item_id", plain_words(F.col("text")).alias("w"))
    out = out.select("item_id", F.array_distinct(shingle_hashes(F.col("w"), shingle)).alias("h"), F.array_distinct(shingle_texts(F.col("w"), shingle)).alias("s"))
    out = out.select("item_id", "h", F.array_join("s", "\n").alias("s"), F.size("s").alias("n")).where("n > 0").withColumn("upper", F.pow(F.lit(2), F.ceil(F.log2("n"))).cast("int"))
    width = F.least(F.col("n"), _may_lack(F.col("upper"), share) + 1)
    out = out.withColumn("width", width).withColumn("least_hits", width - _may_lack(F.col("n"), share))
    return stage(out.withColumn("item", F.monotonically_increasing_id()), "contain-items")


def _questions(upper: int, words: list[int]) -> Column:
    """Those of column h that a partition's filter lets pass, as (upper, h)."""
    return F.transform(F.filter("h", lambda h: _passes(h, words)), lambda h: F.struct(F.lit(upper).alias("upper"), h.alias("h")))


def asked_hashes(whole: DataFrame, item: DataFrame, sketch: DataFrame, share: float = CONTAINED, shingle: int = SHINGLE) -> DataFrame:
    """Rows (doc, text_hash, upper, h): what each document asks the partitions for. whole: doc, text_hash, w; sketch: item, upper, least_hits, h."""
    least = {r["upper"]: r["n"] for r in item.groupBy("upper").agg(F.min("n").alias("n")).collect()}  # one row a power of two
    some = whole.withColumn("size", F.greatest(F.size("w") - shingle + 1, F.lit(1)))
    any_sketch = _filter(sketch.select("h").distinct())
    some = some.withColumn("h", F.array_distinct(F.filter(shingle_hashes(F.col("w"), shingle), lambda h: _passes(h, any_sketch))))
    none = F.array().cast("array<struct<upper:int,h:bigint>>")
    asked = [none]
    for upper, n in sorted(least.items()):
        mine = _questions(upper, _filter(sketch.where(F.col("upper") == upper).select("h").distinct()))
        asked.append(F.when(F.col("size") >= F.ceil(F.lit(share) * F.lit(n) - F.lit(1e-9)), mine).otherwise(none))
    return some.select("doc", "text_hash", "h", "size").select("doc", "text_hash", F.explode(F.concat(*asked)).alias("a")).select("doc", "text_hash", "a.upper", "a.h")


def contained_items(docs: DataFrame, items: DataFrame, share: float = CONTAINED, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs (doc, text_hash, item_id, item_shingles, shared, containment), one a document, text and item."""
    item = sketched(items, share, shingle)
    sketch = stage(item.select("item", "upper", "least_hits", F.explode(F.slice(F.sort_array("h"), F.lit(1), F.col("width"))).alias("h")), "contain-sketches")
    whole = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("text_hash"), plain_words(F.col(text_col)).alias("w"))
    asked = asked_hashes(whole, item, sketch, share, shingle)
    # Repeated rows count twice, which can only add a candidate.
    hits = asked.join(small(sketch), ["upper", "h"]).groupBy("doc", "text_hash", "item").agg(F.count("*").alias("hits"), F.first("least_hits").alias("least_hits"))
    candidates = stage(hits.where("hits >= least_hits").select(F.col("doc").alias("d"), F.col("text_hash").alias("x"), "item"), "contain-candidates")

    shingles = item.select(F.explode(F.split("s", "\n")).alias("s")).select(F.xxhash64("s").alias("h")).distinct()
    held = _filter(shingles)
    own = F.filter(shingle_texts(F.col("w"), shingle), lambda s: _passes(F.xxhash64(s), held))
    same = (F.col("text_hash") == F.col("x")) & F.col("doc").eqNullSafe(F.col("d"))
    texts = whole.join(small(candidates.select("d", "x").distinct()), same, "left_semi").select("doc", "text_hash", F.array_distinct(own).alias("own"))
    pairs = texts.join(small(candidates), same).join(small(item.select("item", "item_id", "n", "s")), "item")
    both = pairs.select("doc", "text_hash", "item_id", F.col("n").alias("item_shingles"), F.size(F.array_intersect(F.split("s", "\n"), "own")).alias("shared"))
    enough = both.where(F.col("shared") >= F.ceil(F.lit(share) * F.col("item_shingles") - F.lit(1e-9)))
    best = enough.groupBy("doc", "text_hash", "item_id").agg(F.max(F.struct((F.col("shared") / F.col("item_shingles")).alias("containment"), "shared", "item_shingles")).alias("b"))
    return best.select("doc", "text_hash", "item_id", F.col("b.item_shingles").cast("long").alias("item_shingles"), F.col("b.shared").cast("long").alias("shared"), "b.containment")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that contain no item."""
    doc, text_hash = fresh(docs.columns, "doc"), fresh(docs.columns, "hash")
    bad = stage(contained_items(docs, items, id_col=id_col, text_col=text_col).select(F.col("doc").alias(doc), F.col("text_hash").alias(text_hash)).distinct(), "contaminated")
    return docs.join(small(bad), (F.xxhash64(text_col) == F.col(text_hash)) & F.col(id_col).eqNullSafe(F.col(doc)), "left_anti")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    # A document id may be on several texts; the most contained counts.
    best = pairs.groupBy(F.col("doc").alias("doc_id"), "item_id").agg(F.max(F.struct("shared", "item_shingles", "containment")).alias("b"))
    return best.select("doc_id", "item_id", "b.item_shingles", "b.shared", "b.containment")


OP2_SQL = rf"""
WITH d AS (
  SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents
), i AS (
  SELECT item_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark
), ds AS (
  SELECT DISTINCT id, unnest(CASE WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {SHINGLE - 2}), lambda k: array_to_string(w[k:k + {SHINGLE - 1}], ' ')) END) AS s FROM d WHERE len(w) > 0
), s AS (
  SELECT DISTINCT id, unnest(CASE WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {SHINGLE - 2}), lambda k: array_to_string(w[k:k + {SHINGLE - 1}], ' ')) END) AS s FROM i WHERE len(w) > 0
), n AS (SELECT id, count(*) AS n FROM s GROUP BY id)
SELECT ds.id AS doc_id, s.id AS item_id, max(n.n) AS item_shingles, count(*) AS shared, count(*) / max(n.n) AS containment
FROM ds JOIN s ON ds.s = s.s JOIN n ON n.id = s.id GROUP BY ds.id, s.id HAVING count(*) >= ceil({CONTAINED} * max(n.n) - 1e-9)
"""
