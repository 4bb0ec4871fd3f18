"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingles.

Test items are short and documents long, so similarity says little and containment is asked
for: which share of an item's shingles the document holds.  An item of n shingles that is
contained to the share t lacks at most n - ceil(t n) of them; of its n - ceil(t n) + 1 smallest
hashes (its bottom MinHash sketch, whose length follows from the size partition) at least one
is therefore in the document, and no contained item is missed.  Items are partitioned by size:
each partition has a number of shingles below which a document can't contain its items, and a
largest hash of its sketches.  A document's shingles are looked up to the largest hash of the
partitions that it is long enough for, all at once: one partition after the other would send the
lower ones once for each.  Pairs that meet in a sketch are verified with the shingles themselves.

Everything is DataFrame expressions.  Words are runs of letters and digits, lower-cased; an item
of fewer than five words is one shingle of all its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.frames import documents

WORDS = 5
CONTAINED = 0.8
#: Sketch rows, of 24 bytes each, that are sent to every executor; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def _words(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def _hashes(words: Column, hashed: Column, k: int) -> Column:
    """Hashes of the runs of k words: of the words' hashes, with k as one more."""
    n = F.size(words)
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.xxhash64(F.lit(k), *[F.get(hashed, i + j) for j in range(k)]))).otherwise(F.array().cast("array<long>"))


def _up_to(hashes: Column, top: Column) -> Column:
    return F.filter(hashes, lambda h: h <= top)


def _reach(parts: list, k: int) -> Column:
    """The largest hash that a document's shingles of k words are looked up to: that of the size partitions whose items it is long enough to hold; null if there are none."""
    out, top = None, None
    for p in sorted(parts, key=lambda p: p["least"]):
        top = p["top"] if top is None else max(top, p["top"])
        fits = F.size("words") >= k + p["least"] - 1
        # The larger partitions are asked first.
        out = F.when(fits, F.lit(top)) if out is None else F.when(fits, F.lit(top)).otherwise(out)
    return out


def _shingles(words: Column, k: Column) -> Column:
    """The distinct runs of k words, as texts.  Words are taken one by one: a slice would go through the whole array each time."""
    n = F.size(words)
    return F.when((n >= k) & (k > 0), F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.concat_ws(" ", *[F.when(k > j, F.get(words, i + j)) for j in range(WORDS)])))).otherwise(F.array().cast("array<string>"))


def item_sketches(items: DataFrame, share: float = CONTAINED) -> DataFrame:
    """item_id, k, part, n, need and hash: the bottom sketch of each item, a row for each hash."""
    worded = items.select("item_id", _words(F.col("text")).alias("words")).where("item_id is not null and size(words) > 0").distinct()
    hashed = worded.withColumn("hashed", F.transform("words", lambda w: F.xxhash64(w))).withColumn("k", F.least(F.size("words"), F.lit(WORDS)))
    each = F.lit(None).cast("array<long>")
    for k in range(1, WORDS + 1):
        each = F.when(F.col("k") == k, _hashes(F.col("words"), F.col("hashed"), k)).otherwise(each)
    sets = hashed.select("item_id", "words", "k", F.array_sort(F.array_distinct(each)).alias("set"))
    n = F.size("set")
    need = F.ceil(F.lit(share) * n - F.lit(1e-9)).cast("int")
    return sets.select("item_id", "words", "k", n.alias("n"), need.alias("need"), F.floor(F.log2(n.cast("double"))).cast("int").alias("part"), F.slice("set", F.lit(1), n - need + 1).alias("sketch"))


def contained_items(docs: DataFrame, items: DataFrame, share: float = CONTAINED) -> DataFrame:
    """doc_id, item_id, n_shingles (of the item), n_shared, containment for every item contained in a document.

    Null, empty and wordless texts and items contain nothing and are contained nowhere.  Repeated
    rows of either side give their pair once; of several texts under one item_id, or documents
    under one doc_id, the pair with the largest containment stays.  Columns other than doc_id,
    item_id and text are not read.
    """
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    sketches = item_sketches(items, share)
    parts = sketches.groupBy("k", "part").agg(F.min("need").alias("least"), F.max(F.element_at("sketch", -1)).alias("top"), F.sum(F.size("sketch")).alias("rows")).collect()
    plain = documents(docs)
    by_k = {k: [p for p in parts if p["k"] == k] for k in sorted({p["k"] for p in parts})}
    worded = plain.select("doc_id", _words(F.col("text")).alias("words"))
    worded = worded.select("doc_id", "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hashed"), *[_reach(mine, k).alias(f"top{k}") for k, mine in by_k.items()])
    wanted = F.array().cast("array<long>")
    for k in by_k:
        top = F.col(f"top{k}")
        wanted = F.concat(wanted, F.when(top.isNotNull(), _up_to(_hashes(F.col("words"), F.col("hashed"), k), top)).otherwise(F.array().cast("array<long>")))
    # explode() would have Spark filter empty arrays first, by the arrays' whole expression, with the words' within its lambda.
    probes = worded.select("doc_id", F.size("words").alias("n_words"), wanted.alias("wanted")).select("doc_id", "n_words", F.explode_outer("wanted").alias("hash"))
    keys = sketches.select("item_id", "k", "need", F.explode("sketch").alias("hash"))
    if sum(p["rows"] for p in parts) <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    pairs = probes.join(keys, "hash").where("n_words >= need + k - 1").select("doc_id", "item_id").distinct()
    # Words and shingles are columns of their own: an expression within a lambda would be worked out for each element.
    asked = sketches.select("item_id", "words", "k").withColumn("item_shingles", _shingles(F.col("words"), F.col("k"))).drop("words")
    sides = pairs.join(asked, "item_id").join(plain, "doc_id").select("doc_id", "item_id", "k", "item_shingles", _words(F.col("text")).alias("words"))
    shingled = sides.select("doc_id", "item_id", "item_shingles", _shingles(F.col("words"), F.col("k")).alias("shingles"))
    sized = shingled.select("doc_id", "item_id", F.size("item_shingles").cast("long").alias("n_shingles"), F.size(F.array_intersect("item_shingles", "shingles")).cast("long").alias("n_shared"))
    # The best of each pair first, the threshold after: a filter right here would be pushed below the words' column and work them out within the lambda.
    best = F.max(F.struct((F.col("n_shared") / F.col("n_shingles")).alias("containment"), "n_shingles", "n_shared")).alias("b")
    found = sized.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.n_shingles", "b.n_shared", "b.containment")
    return found.where(F.col("n_shared") >= F.ceil(F.lit(share) * F.col("n_shingles") - F.lit(1e-9)))


CONTAINED_SQL = r"""
    WITH w AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
    p AS (SELECT DISTINCT side, id, trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')) AS t FROM w),
    a AS (SELECT side, id, string_split(t, ' ') AS ws FROM p WHERE t <> '' AND id IS NOT NULL),
    i AS (SELECT id AS item_id, least(len(ws), 5) AS k, ws FROM a WHERE side = 'i'),
    si AS (SELECT DISTINCT item_id, ws, k, array_to_string(ws[j:j + k - 1], ' ') AS s FROM (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS j FROM i)),
    n AS (SELECT item_id, ws, count(*) AS n_shingles FROM si GROUP BY ALL),
    ks AS (SELECT DISTINCT k FROM i),
    sd AS (SELECT DISTINCT doc_id, ws, s FROM (SELECT id AS doc_id, ws, array_to_string(ws[j:j + k - 1], ' ') AS s
           FROM (SELECT id, ws, k, unnest(range(1, len(ws) - k + 2)) AS j FROM a, ks WHERE side = 'd' AND len(ws) >= k)) WHERE s IN (SELECT s FROM si)),
    m AS (SELECT sd.doc_id, si.item_id, n_shingles, count(*) AS n_shared FROM si JOIN sd USING (s) JOIN n ON n.item_id = si.item_id AND n.ws = si.ws
          GROUP BY sd.doc_id, sd.ws, si.item_id, si.ws, n_shingles)
    SELECT doc_id, item_id, CAST(max_by(n_shingles, n_shared / n_shingles) AS BIGINT) AS n_shingles, CAST(max_by(n_shared, n_shared / n_shingles) AS BIGINT) AS n_shared,
           CAST(max(n_shared / n_shingles) AS DOUBLE) AS containment
    FROM m WHERE n_shared >= ceil(0.8 * n_shingles - 1e-9) GROUP BY doc_id, item_id"""
