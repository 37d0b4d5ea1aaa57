"""Overlapping character windows over documents, and the checks of gold spans against them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import norm_text
from ..sources.scratch import materialize, sent_if_few
from ..sources.shipping import ship_package

SIZE, OVERLAP = 800, 160
SENT_SPANS = 2000
SEARCHED = 1 << 20  # bytes that are searched at once, or one text


def chunk_documents(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, source: str = "source", text: str = "text") -> DataFrame:
    """(source, i, chunk_id, text): windows of ``size`` characters every size - overlap, while they start inside the text.

    The last window goes if it is not the only one and holds nothing but overlap.
    How many windows there are follows from the length, so no window function or
    shuffle is needed. Null and empty texts have none.
    """
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError(f"size must be positive and overlap from 0 to below size, not {size} and {overlap}")
    stride, n = size - overlap, F.length(text)
    windows = F.ceil(n / stride).cast("int")
    tail = n - (windows - 1) * stride
    kept = F.when((windows > 1) & (tail <= overlap), windows - 1).otherwise(windows)
    places = F.when(n > 0, F.sequence(F.lit(0), kept - 1)).otherwise(F.array().cast("array<int>"))
    at = docs.select(F.col(source).cast("string").alias("source"), F.col(text).alias("__text"), F.explode(places).alias("i"))
    return at.select("source", "i", F.concat_ws("-", "source", F.col("i").cast("string")).alias("chunk_id"), F.substring(F.col("__text"), F.col("i") * stride + 1, F.lit(size)).alias("text"))


def texts_of(places: DataFrame, docs: DataFrame, size: int | Column = SIZE, overlap: int | Column = OVERLAP) -> DataFrame:
    """places (source, i, ...) with the text of each window, cut from its document: no other window is made again. Sizes may be columns of ``places``."""
    body = docs.select(F.col("source").cast("string").alias("source"), F.col("text").alias("__text"))
    size, overlap = (v if isinstance(v, Column) else F.lit(v) for v in (size, overlap))
    return places.join(body, "source").withColumn("text", F.substring(F.col("__text"), F.col("i") * (size - overlap) + 1, size)).drop("__text")


def overlaps(chunks: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """(source, i, shared): the text that window i shares with the window before it, the last ``overlap`` characters of that one."""
    before = chunks.select("source", (F.col("i") + 1).alias("i"), F.col("text").alias("__before"))
    both = chunks.join(before, ["source", "i"])
    return both.select("source", "i", F.left(F.col("text"), F.least(F.lit(overlap), F.length("text"))).alias("shared"), (F.right("__before", F.lit(overlap)) == F.left("text", F.lit(overlap))).alias("same"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("n_chunks"), F.count_distinct("text").alias("n_texts"), F.sum(F.length("text")).alias("n_chars"), F.max("i").cast("long").alias("last_i"))


def _hits(spans: list[str]):
    """Rows (source, text) to (n, source), where the normalised text holds span n.

    Of each span of 16 bytes or more its middle 16 are looked for at every place of
    many texts at once, by a product of theirs; where it stands, the span's bytes are
    compared. Shorter spans are searched one by one.
    """
    a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

    def mixed(data: bytes):
        words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        return words[:-8] * a + (words[8:] ^ (words[:-8] >> np.uint64(29))) * b

    raw = [s.encode() for s in spans]
    short = [n for n, s in enumerate(raw) if len(s) < 16]
    keys: dict[int, list[int]] = {}
    for n, s in enumerate(raw):
        if len(s) >= 16:
            at = (len(s) - 16) // 2
            keys.setdefault(int(mixed(s[at : at + 16])[0]), []).append(n)
    known, maybe = np.array(sorted(keys), np.uint64), np.zeros(1 << 20, bool)
    maybe[(known >> np.uint64(44)).astype(np.int64)] = True

    def search(sources, bodies):
        found = {(n, i) for i, body in enumerate(bodies) for n in short if raw[n] in body}
        data = b"\n".join(bodies)  # no span holds a line end, so none goes from one text to the next
        if len(known) and len(data) >= 16:
            product = mixed(data)
            at = np.flatnonzero(maybe[(product >> np.uint64(44)).view(np.int64)])
            at = at[known[np.minimum(np.searchsorted(known, product[at]), len(known) - 1)] == product[at]]
            starts = np.cumsum([0, *(len(x) + 1 for x in bodies)])
            for place, text in zip(at.tolist(), (np.searchsorted(starts, at, "right") - 1).tolist(), strict=True):
                for n in keys[int(product[place])]:
                    start = place - (len(raw[n]) - 16) // 2
                    if start >= 0 and (n, text) not in found and data[start : start + len(raw[n])] == raw[n]:
                        found.add((n, text))
        return [n for n, _ in found], [sources[i] for _, i in found]

    def run(batches):
        import pyarrow as pa

        def rows():
            n, source = search(sources, bodies)
            return pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), pa.array(source, pa.string())], names=["n", "source"])

        sources, bodies, size = [], [], 0
        for batch in batches:
            for r in range(len(batch)):
                sources.append(batch.column(0)[r].as_py())
                bodies.append(" ".join(batch.column(1)[r].as_py().split()).encode())  # as ``norm_text`` does it
                size += len(bodies[-1])
                if size >= SEARCHED:
                    yield rows()
                    sources, bodies, size = [], [], 0
        if bodies:
            yield rows()

    return run


def occurrences(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """texts (source, body), wanted (span_id, span), the spans normalised, to the (span_id, source) where a body, normalised, holds a span.

    Up to ``SENT_SPANS`` spans are sent to all tasks and every body is searched
    for all of them at once. Beyond, a span is looked for only where its rarest inner word
    stands: inner words lie between spaces in the span, so they are whole words
    of any body that holds it. Spans without an inner word are searched plainly.
    """
    spark = texts.sparkSession
    asked = wanted.where("span is not null").select("span_id", "span").limit(SENT_SPANS + 1).collect()
    if len(asked) <= SENT_SPANS:
        ship_package(spark)
        names = spark.createDataFrame([(n, r.span_id) for n, r in enumerate(asked)], T.StructType([T.StructField("n", T.IntegerType()), T.StructField("span_id", wanted.schema["span_id"].dataType)]))
        bodies = texts.where("body is not null").select(F.col("source").cast("string"), "body")
        return bodies.mapInArrow(_hits([r.span for r in asked]), "n int, source string").join(F.broadcast(names), "n").select("span_id", "source")
    texts = texts.select("source", norm_text(F.col("body")).alias("body"))
    inner = wanted.withColumn("w", F.split("span", " ")).withColumn("w", F.when(F.size("w") > 2, F.slice("w", F.lit(2), F.size("w") - 2)))
    words = inner.select("span_id", F.explode(F.array_distinct("w")).alias("word"))
    held = texts.select("source", F.explode(F.array_distinct(F.split("body", " "))).alias("word")).join(words.select("word").distinct(), "word", "left_semi")
    df = held.groupBy("word").agg(F.count("*").alias("df"))
    # a span with a word that no text has is in none, so such words rank first and meet nothing
    ranked = words.join(df, "word", "left").groupBy("span_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word")).alias("rarest"))
    likely = held.join(ranked.select("span_id", F.col("rarest.word").alias("word")), "word").select("span_id", "source")
    found = likely.join(wanted, "span_id").join(texts, "source").where(F.contains("body", "span")).select("span_id", "source")
    return found.unionByName(_short_occurrences(texts, inner.where("w is null").select("span_id", "span")))


def _short_occurrences(texts: DataFrame, short: DataFrame) -> DataFrame:
    """Spans of at most two words, (span_id, span), in texts. Such a span is a piece of a word, or the end of one and the start of the next: distinct pairs of neighbours are searched, not texts, and spans are found by their length.

    A span's every occurrence starts inside some word or pair of words; the pieces of
    the lengths that spans have are cut from the distinct pairs and joined by equality.
    """
    words = texts.select("source", F.split("body", " ").alias("w"))
    pair = F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1)))
    pairs = words.select("source", F.explode(F.array_distinct(pair)).alias("pair"))
    lengths = F.broadcast(short.agg(F.sort_array(F.collect_set(F.length("span"))).alias("lengths")))  # one row; spans are shorter than two words
    cut = pairs.select("pair").distinct().crossJoin(lengths).select("pair", F.explode("lengths").alias("n")).where(F.length("pair") >= F.col("n"))
    pieces = cut.select("pair", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("pair") - F.col("n") + 1), lambda i: F.substring(F.col("pair"), i, F.col("n"))))).alias("span"))
    places = pieces.join(short, "span").select("span_id", "pair").distinct()
    return pairs.join(places, "pair").select("span_id", "source").distinct()


def validate_contexts(spans: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """spans (span_id, span) to span_id, status: OK in one chunk, SPLIT in a document but no chunk, MISSING in no document.

    Chunks are looked at only in documents that hold a span, joined by source.
    """
    wanted = materialize(spans.select("span_id", norm_text(F.col("span")).alias("span")), "spans")
    found = materialize(occurrences(docs.select(F.col("source").cast("string").alias("source"), F.col("text").alias("body")), wanted), "found")
    held, _ = sent_if_few(materialize(found.select("source").distinct(), "sources"))
    parts = chunks.join(held, "source", "left_semi").select("source", norm_text(F.col("text")).alias("piece"))
    inside = found.join(wanted, "span_id").join(parts, "source").where(F.contains("piece", "span")).select("span_id").distinct()
    flags = wanted.select("span_id").join(found.select("span_id").distinct().withColumn("doc", F.lit(True)), "span_id", "left").join(inside.withColumn("chunk", F.lit(True)), "span_id", "left")
    status = F.when(F.col("chunk"), "OK").when(F.col("doc"), "SPLIT").otherwise("MISSING")
    return flags.select("span_id", status.alias("status"))


def statuses(spans: DataFrame, docs: DataFrame, configs: list[tuple[int, int]]) -> DataFrame:
    """(size, overlap, span_id, status) as ``validate_contexts`` gives it, for several window sizes: the corpus is searched once, and only documents that hold a span are cut."""
    wanted = materialize(spans.select("span_id", norm_text(F.col("span")).alias("span")), "spans")
    bodies = docs.select(F.col("source").cast("string").alias("source"), "text")
    found = materialize(occurrences(bodies.select("source", F.col("text").alias("body")), wanted), "found")
    sources, _ = sent_if_few(materialize(found.select("source").distinct(), "sources"))
    held = materialize(bodies.join(sources, "source", "left_semi"), "held")
    pieces = None
    for size, overlap in configs:
        one = chunk_documents(held, size, overlap).select(F.lit(size).alias("size"), F.lit(overlap).alias("overlap"), "source", norm_text(F.col("text")).alias("piece"))
        pieces = one if pieces is None else pieces.unionByName(one)
    inside = found.join(wanted, "span_id").join(pieces, "source").where(F.contains("piece", "span")).select("size", "overlap", "span_id").distinct().withColumn("chunk", F.lit(True))
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("size"), F.lit(o).alias("overlap")) for s, o in configs])).alias("c")
    all_ = wanted.select("span_id", each).select("span_id", "c.*").join(found.select("span_id").distinct().withColumn("doc", F.lit(True)), "span_id", "left").join(inside, ["size", "overlap", "span_id"], "left")
    return all_.select("size", "overlap", "span_id", F.when(F.col("chunk"), "OK").when(F.col("doc"), "SPLIT").otherwise("MISSING").alias("status"))


def ceilings(spans: DataFrame, docs: DataFrame, configs: list[tuple[int, int]], k: int = 5) -> DataFrame:
    """Per (size, overlap): questions of which a span fits one chunk, and of which one could fit k adjacent chunks."""
    lengths = spans.select("span_id", F.length(norm_text(F.col("span"))).alias("length"))
    reach = (k - 1) * (F.col("size") - F.col("overlap")) + F.col("size")
    rows = statuses(spans, docs, configs).join(lengths, "span_id")
    return rows.groupBy("size", "overlap").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "OK").alias("in_one_chunk"), F.count_if(F.col("length") <= reach).alias("within_k"))
