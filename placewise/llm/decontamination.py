"""Benchmark decontamination: marks every document word inside an occurrence of a benchmark window.

Words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after lower-casing A-Z. A window is ten words in a row of an item;
an item of one to nine words is one window. Documents are scanned once: each word position and each window length that
occurs gives a 64-bit hash, looked up in the set of windows, and every hit is verified on the words themselves. Everything
is DataFrame code.

The set, with its words and item ids, is broadcast while it fills at most `BROADCAST_BYTES` (summed first). A larger one is
joined by hash with the positions, each of which brings the words of its own window and no more, so that the bytes grow
with the texts; adaptive execution splits skewed hashes, and what a document is besides its positions bypasses that join.
Either way only hits go on, so a passage that a third of all documents share costs each of them its own few rows.

Very long texts cost one row a position inside the scan. Null and empty texts have no words, equal rows count as copies, and
empty tables give no hits or no rows. Extra columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from placewise.llm.storage import free_name, stored

WINDOW = 10
#: Words, item ids and 64 bytes more for each window.
BROADCAST_BYTES = 64 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text; none of a null. `lower` is the faster way to the same result where all characters are ASCII."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    plain = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(plain, _BETWEEN), "")


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """size, mark (hash), gram (the words) and items (ids as strings) of every distinct window.

    Items without words have none; an item with a null id gives windows that mark words but names no item.
    """
    held = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    cut = held.select("item", size.alias("size"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice("w", i, size))).alias("gram"))
    return cut.groupBy("size", "gram").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("mark", _mark("gram", window))


def _mark(gram: str, window: int) -> Column:
    """Hash of a window's words; the places behind a shorter one are null and change nothing."""
    return F.xxhash64(*[F.xxhash64(F.get(F.col(gram), F.lit(i))) for i in range(window)])


def _marks_at(hashes: str, at: Column, size: int, window: int) -> Column:
    return F.xxhash64(*[F.get(F.col(hashes), at + (i - 1)) if i < size else F.xxhash64(F.lit(None).cast("string")) for i in range(window)])


def identity(docs: DataFrame) -> list[Column]:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.col("doc_id").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.length(text).alias("text_size")]


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_hash, text_size, copies, n_words, spans (first word from 1, words) and items of every document.

    Rows with equal doc_id and text are one row with their number in `copies`; null and repeated ids are told apart by the
    text. Null and empty texts have no words. With an empty benchmark no document has a span.
    """
    grams = stored(item_windows(items, window), "windows")
    sizes = sorted(r["size"] for r in grams.select("size").distinct().collect())  # at most `window` numbers
    known = grams.select("mark", F.col("size").alias("gram_size"), "gram", "items")
    lengths = [F.octet_length(F.array_join(c, " ")) for c in ("gram", "items")]
    small = (grams.agg(F.sum(lengths[0] + lengths[1] + 64)).first()[0] or 0) <= BROADCAST_BYTES
    read = docs.select(*identity(docs), words(F.col("text")).alias("w"))
    # Row 0 stands for the text itself; the others are its positions, once for each window size.
    turns = max(1, len(sizes))
    placed = read.withColumn("hashes", F.transform("w", lambda w: F.xxhash64(w))).select("*", F.explode(F.sequence(F.lit(0), F.size("w") * turns)).alias("turn"))
    at, turn = F.floor((F.col("turn") - 1) / turns).cast("int") + 1, F.pmod(F.col("turn") - 1, F.lit(turns))
    size = F.element_at(F.array(*[F.lit(s) for s in sizes or [window]]), turn + 1)
    mark = F.lit(None).cast("bigint")
    for i, s in enumerate(sizes):
        mark = F.when((turn == i) & (F.col("turn") > 0) & (at + (s - 1) <= F.size("w")), _marks_at("hashes", at, s, window)).otherwise(mark)
    own = ["doc_id", "text_hash", "text_size"]
    marked = placed.select(*own, "turn", "w", at.alias("at"), size.alias("size"), mark.alias("h"))
    # Joined by the hash alone; the words themselves are compared on the few rows that match.
    if small:
        proven = (F.col("size") == F.col("gram_size")) & (F.slice("w", F.greatest("at", F.lit(1)), F.col("size")) == F.col("gram"))
        found = marked.join(F.broadcast(known), F.col("h") == F.col("mark"), "left").where((F.col("turn") == 0) | F.col("mark").isNotNull() & proven).select(
            *own, F.when(F.col("turn") == 0, F.size("w")).alias("n"), F.when(F.col("turn") > 0, F.struct("at", "size")).alias("m"), "items"
        )
    else:
        places = marked.where("h IS NOT NULL").select(*own, "at", "size", "h", F.slice("w", F.col("at"), F.col("size")).alias("held"))
        same = (F.col("h") == F.col("mark")) & (F.col("size") == F.col("gram_size")) & (F.col("held") == F.col("gram"))
        matched = places.join(known, same).select(*own, F.lit(None).cast("int").alias("n"), F.struct("at", "size").alias("m"), "items")
        whole = read.select(*own, F.size("w").alias("n"), F.lit(None).cast(matched.schema["m"].dataType).alias("m"), F.lit(None).cast("array<string>").alias("items"))
        found = whole.unionAll(matched)
    return found.groupBy("doc_id", "text_hash", "text_size").agg(
        F.count("n").alias("copies"),
        F.max("n").cast("bigint").alias("n_words"),
        F.collect_set("m").alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def covered(spans: Column) -> Column:
    """Number of words in the union of spans: each span in order adds what lies behind all earlier ones."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
    def step(seen, s):
        last = s["at"] + s["size"] - 1
        return F.struct((seen["n"] + F.greatest(last - F.greatest(seen["end"], s["at"] - 1), F.lit(0))).cast("bigint").alias("n"), F.greatest(seen["end"], last).alias("end"))
    return F.aggregate(F.array_sort(spans), start, step, lambda seen: seen["n"])


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = hits(docs, items, window)
    one = found.select("doc_id", "n_words", covered(F.col("spans")).alias("n_hit"), "items", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return one.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def _with_hits(docs: DataFrame, items: DataFrame, window: int) -> tuple[DataFrame, list[str]]:
    found = hits(docs, items, window).where(F.size("spans") > 0)
    names = [free_name(docs, n) for n in ("found_doc", "found_hash", "found_size", "found_spans")]
    found = found.select(*[F.col(c).alias(n) for c, n in zip(("doc_id", "text_hash", "text_size", "spans"), names)])
    _, mark, size = identity(docs)
    same = F.col("doc_id").eqNullSafe(F.col(names[0])) & (mark == F.col(names[1])) & (size == F.col(names[2]))
    return docs.join(found, same, "left"), names


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of `docs`, all columns unchanged, without any benchmark window.

    The hit documents are stored by themselves, so that few of them are broadcast and the texts of all others stay in place.
    """
    hit = stored(hits(docs, items, window).where(F.size("spans") > 0).select("doc_id", "text_hash", "text_size"), "hit-documents")
    names = [free_name(docs, n) for n in ("hit_doc", "hit_hash", "hit_size")]
    hit = hit.toDF(*names)
    _, mark, size = identity(docs)
    same = F.col("doc_id").eqNullSafe(F.col(names[0])) & (mark == F.col(names[1])) & (size == F.col(names[2]))
    return docs.join(hit, same, "left_anti")


def clean_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """All rows of `docs`; hit words, and the signs up to the next word, are cut out of the text."""
    joined, names = _with_hits(docs, items, window)
    text = F.col("text").cast("string")
    pieces = F.regexp_extract_all(text, F.lit(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*?(?=[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]|$)"), F.lit(0))
    gone = F.array_distinct(F.flatten(F.transform(F.col(names[3]), lambda s: F.sequence(s["at"], s["at"] + s["size"] - 1))))
    left = F.array_join(F.filter(pieces, lambda _, i: ~F.array_contains(gone, i + 1)), "")
    fixed = F.when(F.col(names[3]).isNull(), F.col("text")).otherwise(left)
    return joined.select(*[fixed.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Hits of all benchmark items in all documents."""
    return report(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"))


OP1_SQL = rf"""
WITH docs AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents
), items AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM benchmark
), grams AS (
    SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 10) AS size, list_slice(w, i, i + least(len(w), 10) - 1) AS gram
    FROM items, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS u(i) WHERE len(w) > 0
), places AS (
    SELECT doc_id, i, size, list_slice(w, i, i + size - 1) AS gram
    FROM docs, (SELECT DISTINCT size FROM grams) AS s, unnest(range(1, len(w) - size + 2)) AS u(i)
), found AS (
    SELECT doc_id, i, size, item FROM places JOIN grams USING (size, gram)
), hit AS (
    SELECT doc_id, count(DISTINCT p) AS n FROM found, unnest(range(i, i + size)) AS u(p) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS list FROM found GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(named.n, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
