"""Mixing sources to target weights by drawing fixed-length blocks of words.

The words of a source, document after document, form one long sequence that is
cut into blocks of fixed length.  A source gets as many slots as its target
needs, and the last one is cut, so exactly the target's words are taken.  First
the number of slots per source and output shard is drawn: a multinomial draw over
the shards given the source's total.  The prefix sums of these counts are the slot
ranges of the shards.  Slot numbers run through pseudorandom permutations of the
block numbers (one per pass over the source), so no block is taken twice before
every block was taken once.  Blocks and documents meet by an equi-join on source
and block number.

Word offsets need no task per source: documents are dealt to hash buckets,
summed per bucket, and numbered inside a bucket.  Slots are generated in chunks.
Only the table of sources is ordered as a whole.

Defined results: null text has size 0; a document of size 0 is never taken; null
source is a source of its own, last in order; rows that repeat an id and text
follow each other and are taken each by its own place; an empty table gives no
rows; other columns are carried (``mixed_documents``) or ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from marketframe.functions.scan import Running, running
from marketframe.functions.storage import materialise
from marketframe.llm.common import WORD, parts_for, pick, table
from marketframe.llm.registry import query

#: Weights by position of the source in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: A target is at most this many times the source's size.
MOST_PASSES = 3
#: Words per block.
BLOCK_WORDS = 128
#: Rounds of the permutation; its bits mix well beyond twice the logarithm of the blocks.
ROUNDS = 24
#: Documents per offset bucket, and slots generated by one row.
BUCKET_DOCS = 2_000
SLOT_CHUNK = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """The source as a string that is never null; a null source differs from any string."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_PASSES
) -> DataFrame:
    """``source, source_size`` -> with ``target``: weighted shares of the total size.

    A target stops at ``most`` times its source's size and the excess is shared by
    weight among the others.  The fixed point gives every source the smaller of its
    cap and ``weight * level``: in order of cap per weight, the level is what the
    sources not yet capped would share, taken where the first cap suffices.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(ordered) - 1) % len(weights)
    rows = sizes.withColumn(
        "w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), rank + 1)
    ).withColumn("cap", most * F.col("source_size").cast("double"))
    rows = rows.withColumn("reach", F.col("cap") / F.col("w"))
    everything = Window.partitionBy()
    by_reach = Window.orderBy("reach", F.col("source").asc_nulls_last())
    before = by_reach.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(
        F.sum("cap").over(before), F.lit(0.0)
    )
    weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / weight)
    level = F.max(F.when(F.col("reach") >= F.col("level"), F.col("level"))).over(everything)
    return rows.withColumn(
        "target", F.least("cap", F.col("w") * F.coalesce(level, F.lit(0.0)))
    ).select("source", "source_size", "target")


def lay_out(docs: DataFrame, source: str, doc_id: str, text: str, carry: Sequence[str] = ()):
    """Documents with ``key, size, first_word``: their place in the words of their source."""
    rows = pick(
        docs, doc_id=doc_id, source=source, text=text, **{f"c_{i}": c for i, c in enumerate(carry)}
    )
    rows = rows.select(
        "*",
        source_key(F.col("source")).alias("key"),
        word_count(F.col("text")).alias("size"),
        F.xxhash64("text").alias("tie"),
    )
    if not carry:
        rows = rows.drop("text")
    buckets = parts_for(docs.count(), BUCKET_DOCS)
    chunk = F.pmod(F.xxhash64("doc_id", "tie"), F.lit(buckets))
    offset = Running("first_word", "sum", F.col("size"), inclusive=False)
    return running(rows, ["key"], chunk, ["doc_id", "tie"], [offset])


def permuted(
    index: Column, n: Column, key: Column, rounds: int = ROUNDS, inverse: bool = False
) -> Column:
    """A pseudorandom permutation of 0..n-1 applied to ``index``, chosen by ``key``.

    Swap-or-not: every round pairs x with K - x (mod n) and swaps the pair or not
    by one hash bit that both members agree on, which is a bijection for any n.  A
    round undoes itself, so the rounds in reverse order give the inverse.
    """

    def step(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        bit = F.xxhash64(F.greatest(x, partner), r, key).bitwiseAND(F.lit(1))
        return F.when(bit == 1, partner).otherwise(x)

    ends = (rounds - 1, 0) if inverse else (0, rounds - 1)
    return F.aggregate(F.sequence(*map(F.lit, ends)), index.cast("long"), step)


def wanted_slots(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``key, source_size, blocks, wanted, slots``: words to take, and slots that hold them.

    Only the last block of a source may be short; one slot more covers the case that
    it comes early in the last pass.
    """
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    rows = targets.filter(F.col("source_size") > 0).select(
        source_key(F.col("source")).alias("key"),
        "source_size",
        blocks.alias("blocks"),
        F.round("target").cast("long").alias("wanted"),
    )
    rest = F.expr("wanted % source_size")
    last = F.when(
        rest > 0, F.least(F.col("blocks"), F.ceil(rest / block_words).cast("long") + 1)
    ).otherwise(F.lit(0))
    return rows.withColumn("slots", F.expr("wanted div source_size") * F.col("blocks") + last)


def _tasks(rows: DataFrame, slots: str) -> int:
    """Tasks for generating the slots of ``rows``: few bytes are read, many rows made.

    A number given to ``repartition`` keeps adaptive execution from joining them.
    """
    return parts_for(rows.agg(F.sum(slots)).first()[0] or 0, 16 * SLOT_CHUNK)


def draw_counts(wanted: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """``key, shard, first_slot, count``: multinomial slot counts and where their ranges start.

    Every slot draws a shard; a row of at most ``SLOT_CHUNK`` slots counts its draws
    before they are shuffled.  The result has sources x shards rows.
    """
    chunks = (
        wanted.filter("slots > 0")
        .select("key", "slots", F.explode(F.expr(f"sequence(0L, (slots - 1) div {SLOT_CHUNK})")).alias("chunk"))
        .repartition(_tasks(wanted, "slots"), "key", "chunk")
    )
    last = F.least(F.col("slots"), (F.col("chunk") + 1) * SLOT_CHUNK) - 1
    draws = chunks.select("key", F.explode(F.sequence(F.col("chunk") * SLOT_CHUNK, last)).alias("draw"))
    shard = F.pmod(F.xxhash64("draw", "key", F.lit(seed + 1)), F.lit(shards))
    counts = draws.groupBy("key", shard.alias("shard")).agg(F.count(F.lit(1)).alias("count"))
    before = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        "key", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first_slot"), "count"
    )


def draw_slots(
    wanted: DataFrame, counts: DataFrame, seed: int = 0, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """One row per drawn block: ``key, pass, block, slot, shard, take, cut``.

    ``take`` is the number of words taken from the block's start; ``cut`` marks the
    one block of a source of which only a part is taken.
    """
    ranges = (
        counts.join(wanted, "key")
        .withColumn("chunk", F.explode(F.expr(f"sequence(0L, (count - 1) div {SLOT_CHUNK})")))
        .repartition(_tasks(counts, "count"), "key", "shard", "chunk")
    )
    first = F.col("first_slot") + F.col("chunk") * SLOT_CHUNK
    last = F.least(F.col("first_slot") + F.col("count"), first + SLOT_CHUNK) - 1
    slots = ranges.withColumn("slot", F.explode(F.sequence(first, last)))
    blocks = F.col("blocks")
    slots = slots.withColumn("pass", F.expr("slot div blocks")).withColumn(
        "stream", F.xxhash64("key", "pass", F.lit(seed))
    )
    slots = slots.withColumns(
        {
            "block": permuted(F.col("slot") % blocks, blocks, F.col("stream")),
            # the place of the short block in this pass
            "short_at": permuted(blocks - 1, blocks, F.col("stream"), inverse=True),
        }
    )
    short = blocks * block_words - F.col("source_size")
    at = F.col("slot") % blocks
    before = F.col("pass") * F.col("source_size") + at * block_words
    before = before - F.when(F.col("short_at") < at, short).otherwise(0)
    whole = F.lit(block_words) - F.when(F.col("short_at") == at, short).otherwise(0)
    take = F.least(whole, F.col("wanted") - before)
    return (
        slots.withColumns({"take": take.cast("long"), "cut": take < whole})
        .filter("take > 0")
        .select("key", "pass", "block", "slot", "shard", "take", "cut")
    )


def fragments(laid: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Non-empty documents cut at block borders: ``block, from_word, words`` per piece."""
    start, stop = F.col("first_word"), F.col("first_word") + F.col("size")
    pieces = laid.filter("size > 0").withColumn(
        "block",
        F.explode(
            F.expr(
                f"sequence(first_word div {block_words}, (first_word + size - 1) div {block_words})"
            )
        ),
    )
    from_word = F.greatest(start, F.col("block") * block_words)
    to_word = F.least(stop, (F.col("block") + 1) * block_words)
    return pieces.withColumns({"from_word": from_word, "words": to_word - from_word})


def mix(
    docs: DataFrame,
    shards: int = 64,
    seed: int = 0,
    weights: Sequence[float] = WEIGHTS,
    most: int = MOST_PASSES,
    block_words: int = BLOCK_WORDS,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
):
    """Laid-out documents, targets and drawn slots, as three written tables."""
    laid = materialise(lay_out(docs, source, doc_id, text), "mix-layout")
    sizes = laid.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialise(source_targets(sizes, weights, most), "mix-targets")
    wanted = wanted_slots(targets, block_words)
    counts = materialise(draw_counts(wanted, shards, seed), "mix-counts")
    slots = materialise(draw_slots(wanted, counts, seed, block_words), "mix-slots")
    return laid, targets, slots


def taken_part(take: Column, block_words: int) -> Column:
    """Words of a fragment among the first ``take`` words of its block."""
    reach = F.col("block") * block_words + take - F.col("from_word")
    return F.least(F.col("words"), F.greatest(reach, F.lit(0)))


def taken_words(
    laid: DataFrame, targets: DataFrame, slots: DataFrame, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """Per document: its size, its source's size and target, and the words taken."""
    times = slots.groupBy("key", "block").agg(
        F.count_if(~F.col("cut")).alias("times"),
        F.max(F.when(F.col("cut"), F.col("take"))).alias("part"),
    )
    row = ["key", "first_word", "doc_id", "size"]
    words = F.col("words") * F.coalesce("times", F.lit(0))
    words = words + taken_part(F.coalesce("part", F.lit(0)), block_words)
    taken = (
        fragments(laid, block_words)
        .join(times, ["key", "block"], "left")
        .groupBy(*row)
        .agg(F.sum(words).alias("taken"))
    )
    empty = laid.filter("size = 0").select(*row, F.lit(0).cast("long").alias("taken"))
    per_source = targets.select(
        source_key(F.col("source")).alias("key"), "source_size", "target"
    )
    return (
        taken.unionByName(empty)
        .join(per_source, "key")
        .select("doc_id", "size", "source_size", "target", "taken")
    )


def _words_of_text() -> Column:
    """``words`` words of ``text`` after the first ``skip``, with the white space between them."""
    spaced = F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    part = F.array_join(F.slice(spaced, (F.col("skip") + 1).cast("int"), F.col("words").cast("int")), "")
    return F.btrim(part, F.lit(" \t\n\x0b\x0c\r"))


def write_shards(
    docs: DataFrame,
    path: str,
    shards: int = 64,
    seed: int = 0,
    block_words: int = BLOCK_WORDS,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> None:
    """The mixed blocks under ``path/shard=N``: ``source, doc_id, slot, block, from_word, text``.

    A block is a row per document with words in it, in the order of ``from_word``.
    Every range of slots is written by its own task, so a shard has several files.
    """
    _, _, slots = mix(
        docs, shards, seed, block_words=block_words, doc_id=doc_id, source=source, text=text
    )
    laid = lay_out(docs, source, doc_id, text, carry=[text])
    places = fragments(laid.select("key", "first_word", "size"), block_words)
    places = places.select("key", "first_word", "block", "from_word", "words")
    # a document is cut into its pieces once, and only pieces meet the slots
    cut = (
        places.groupBy("key", "first_word")
        .agg(F.collect_list(F.struct("block", "from_word", "words")).alias("pieces"))
        .join(laid.filter("size > 0"), ["key", "first_word"])
    )
    words = F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))

    def cut_text(w: Column) -> Column:
        return F.transform(
            "pieces",
            lambda p: F.struct(
                p["block"].alias("block"),
                p["from_word"].alias("from_word"),
                p["words"].alias("words"),
                F.slice(
                    w, (p["from_word"] - F.col("first_word") + 1).cast("int"), p["words"].cast("int")
                ).alias("spaced"),
            ),
        )

    # a one-element list holds the words, so that they are found once a text
    pieces = F.flatten(F.transform(F.array(words), cut_text))
    pieces = cut.select("key", "source", "doc_id", F.explode(pieces).alias("p"))
    rows = pieces.select("key", "source", "doc_id", "p.*").join(slots, ["key", "block"])
    count = taken_part(F.col("take"), block_words)
    rows = rows.withColumn("n", count.cast("int")).filter("n > 0")
    text_of = F.btrim(F.array_join(F.slice("spaced", F.lit(1), F.col("n")), ""), F.lit(" \t\n\x0b\x0c\r"))
    out = rows.select("shard", "source", "doc_id", "slot", "block", "from_word", text_of.alias("text"))
    out = out.repartition("shard", (F.col("slot") / SLOT_CHUNK).cast("long"))
    out.sortWithinPartitions("shard", F.xxhash64("slot", "source"), "from_word").write.partitionBy(
        "shard"
    ).parquet(path)


def mixed_documents(
    docs: DataFrame,
    shards: int = 64,
    seed: int = 0,
    block_words: int = BLOCK_WORDS,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    length: str | None = "n_chars",
) -> DataFrame:
    """The mix as documents: a row for each run of neighbouring taken blocks of a document.

    Columns are those of ``docs``; ``text`` holds the words of the run with the
    white space between them (the whole text, unchanged, where the run is the whole
    document), and ``length``, if named and present, its characters.  A document
    comes as often as it is taken, up to the number of passes.
    """
    _, _, slots = mix(
        docs, shards, seed, block_words=block_words, doc_id=doc_id, source=source, text=text
    )
    laid = lay_out(docs, source, doc_id, text, carry=docs.columns)
    pieces = fragments(laid.select("key", "first_word", "size"), block_words).join(
        slots.select("key", "block", "pass", "take", "cut"), ["key", "block"]
    )
    pieces = pieces.withColumn("words", taken_part(F.col("take"), block_words)).filter("words > 0")
    # a run ends with a cut block, which is a run of its own
    in_pass = Window.partitionBy("key", "first_word", "pass", "cut").orderBy("block")
    runs = (
        pieces.withColumn("run", F.col("block") - F.row_number().over(in_pass))
        .groupBy("key", "first_word", "pass", "cut", "run")
        .agg(
            (F.min("from_word") - F.col("first_word")).alias("skip"),
            F.sum("words").alias("words"),
        )
        .drop("pass", "cut", "run")
    )
    runs = materialise(runs, "mix-runs")
    rows = laid.filter("size > 0").join(runs, ["key", "first_word"])
    piece = F.when(F.col("words") == F.col("size"), F.col("text")).otherwise(_words_of_text())
    out = rows.select(piece.alias("piece"), *[f"c_{i}" for i in range(len(docs.columns))])

    def value(i: int, name: str) -> Column:
        if name == text:
            return F.col("piece").alias(name)
        if name == length:
            return F.char_length("piece").cast(docs.schema[name].dataType).alias(name)
        return F.col(f"c_{i}").alias(name)

    return out.select(*[value(i, name) for i, name in enumerate(docs.columns)])


@query("op10_mix_sources")
def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(*mix(table(spark, sf_dir, "documents")))
