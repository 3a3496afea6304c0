"""Canonical exact digests of documents, DataFrame functions only.

A text is normalised (Unicode compatibility composition), case-folded and white-space-folded by
the ICU library that Spark ships, called as SQL functions. Two seeded 64-bit xxhash values of the
canonical text make a wide bucket key; inside equal buckets the canonical bytes are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Documents in a block of neighbours: few enough to be held in a window's memory without spilling.
BLOCK_ROWS = 2000
#: Members of a bucket that meet one copy of its first text.
COPIES_PER_TEXT = 1000
#: Blocks whose numbers (16 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_BLOCKS = 100_000
_SEEDS = (0x5EED, 0xB0B5)


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC again, white-space runs to one space, ends trimmed. Null: empty."""
    compose = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), compose(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.trim(F.regexp_replace(compose(folded), r"(?U)\s+", " "))


def digest(canon: Column) -> Column:
    """32 hex digits: two xxhash values under different seeds."""
    wide = [F.lpad(F.lower(F.hex(F.xxhash64(F.lit(s), canon))), 16, "0") for s in _SEEDS]
    return F.concat(*wide)


def with_next(df: DataFrame, key: str, carried: str, derive=lambda d: d, derived: tuple[str, ...] = ()) -> DataFrame:
    """Adds next_<c> for ``carried`` and each derived column c: its value in the row with the next
    larger key (null keys come first), and after the last row its value in the first row.
    ``derive`` adds the derived columns to rows with ``carried``.

    Keys are cut into blocks of equal width, about BLOCK_ROWS rows each; neighbours inside a block
    come from a window over that block, and the last row of a block takes the first row of the next
    block, found by the same function over the blocks' first rows, which are 1/BLOCK_ROWS as many.
    No window spans all rows, and ties are ordered by the carried column.
    """
    n, low, high = df.agg(F.count("*"), F.min(key), F.max(key)).first()
    one_block = n <= BLOCK_ROWS or low is None
    if one_block:
        block = F.lit(0).cast("long")
    else:
        width = max(1, -(-(int(high) - int(low) + 1) * BLOCK_ROWS // n))
        block = F.coalesce(F.expr(f"({key} div {width}L) - ({int(low)}L div {width}L) + 1"), F.lit(0).cast("long"))
    cols = (carried, *derived)
    blocked = df.withColumn("_block", block)
    w = Window.partitionBy("_block").orderBy(F.col(key).asc_nulls_first(), carried)
    inner = derive(blocked).withColumn("_next", F.lead(F.struct(*cols)).over(w))
    # a block's first row: its smallest key from a scan of keys alone, then only that row's text
    heads = blocked.groupBy("_block").agg(F.min(key).alias("_key")).toDF("_head", "_key")
    heads = F.broadcast(heads) if n // BLOCK_ROWS <= BROADCAST_BLOCKS else heads
    first = blocked.join(heads, (F.col("_block") == F.col("_head")) & F.col(key).eqNullSafe(F.col("_key")))
    first = first.groupBy("_block").agg(F.min(carried).alias(carried))
    if one_block:
        after = derive(first).select("_block", F.struct(*cols).alias("_after"))
    else:
        after = with_next(first.withColumnRenamed("_block", "_number"), "_number", carried, derive, derived).select(F.col("_number").alias("_block"), F.struct(*[F.col(f"next_{c}").alias(c) for c in cols]).alias("_after"))
    out = inner.join(after, "_block", "left").withColumn("_next", F.coalesce("_next", "_after"))
    return out.select(*df.columns, *derived, *[F.col(f"_next.{c}").alias(f"next_{c}") for c in cols])


def with_groups(docs: DataFrame, prints: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds group_size and class_id to prints (doc_id, fingerprint, ...), from a byte comparison of
    canonical texts inside buckets of two or more: a row whose bytes differ from the bucket's first
    text (a hash collision) gets its own text's SHA-256 appended to the fingerprint, so equal
    fingerprints mean equal canonical bytes. Rows without an id stand alone.

    A hot bucket is met by several copies of its first text, one for COPIES_PER_TEXT members; the
    buckets are written first, so that joins with a hot one can be split.
    """
    sizes = prints.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("doc_id").alias("class_id")).filter("n > 1 and class_id is not null")
    buckets = scratch.write(sizes.withColumn("copies", F.ceil(F.col("n") / COPIES_PER_TEXT)), "buckets")
    shared = prints.filter("doc_id is not null").select("doc_id", "fingerprint").join(buckets, "fingerprint")
    shared = scratch.write(shared.groupBy("doc_id", "fingerprint", "n", "class_id", "copies").agg(F.count("*").alias("times")), "shared")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    canon = lambda df: df.withColumn("canon", canonical(F.col("text"))).withColumn("own", digest(F.col("canon"))).filter("own = fingerprint")
    # texts are joined by a shuffle at every size, so that small tables show what large ones cost
    members = canon(texts.join(shared.hint("merge"), "doc_id")).select("doc_id", "fingerprint", "n", "class_id", F.pmod(F.xxhash64("doc_id"), "copies").alias("salt"), "canon")
    firsts = canon(texts.join(shared.filter("doc_id = class_id").hint("merge"), "doc_id")).groupBy("fingerprint", "copies").agg(F.min("canon").alias("first_text"))
    firsts = firsts.select("fingerprint", "first_text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("salt"))
    same = F.col("canon") == F.col("first_text")
    checked = members.join(firsts, ["fingerprint", "salt"]).select("doc_id", "fingerprint", "n", F.when(same, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.when(~same, F.sha2("canon", 256)).alias("sha"))
    checked = checked.groupBy("doc_id", "fingerprint").agg(F.max("n").alias("group_size"), F.min("class_id").alias("class_id"), F.max("sha").alias("sha"))
    out = prints.join(checked, ["doc_id", "fingerprint"], "left")
    mark = F.concat_ws("-", "fingerprint", "sha").alias("fingerprint")
    return out.select(*[mark if c == "fingerprint" else c for c in prints.columns], F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.coalesce("class_id", "doc_id").alias("class_id"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row per row of docs: fingerprints of the text and of its edited text (the last quarter of
    the code points replaced by as many first code points of the next document).

    Null text counts as empty; a single document follows itself; rows that repeat a doc_id are
    ordered by text; extra columns are ignored. An exact digest is alike (1.0) or not (0.0).
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    linked = with_next(base, "doc_id", "text", lambda d: d.withColumn("fingerprint", digest(canonical(F.col("text")))), ("fingerprint",))
    n = F.char_length("text").cast("long")
    linked = linked.withColumn("n_chars", n).withColumn("cut", F.floor(F.col("n_chars") / 4).cast("int"))
    linked = linked.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars as int) - cut)"), F.expr("substring(next_text, 1, cut)")))
    linked = linked.select("doc_id", "n_chars", "fingerprint", "next_fingerprint", F.sha2("edited", 256).alias("edited_sha256"), digest(canonical(F.col("edited"))).alias("edited_fingerprint"))
    alike = lambda c: (F.col("fingerprint") == F.col(c)).cast("double")
    return linked.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", alike("edited_fingerprint").alias("near_edited"), alike("next_fingerprint").alias("near_next"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's digest, its edited text's, and the size and first id of its group of equal texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scratch = Scratch(spark, "fingerprints")
    prints = scratch.write(fingerprint_documents(docs), "prints")
    return with_groups(docs, prints, scratch)
