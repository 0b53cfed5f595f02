"""Mixing sources to target weights, in DataFrame functions only.

A source's words are packed into blocks of fixed length. The mix has as many
slots as blocks are due; each output shard draws which source each of its slots
goes to, without replacement from what the sources are due: the counts are
multinomial, given that every source comes to its target. A source's slots map,
epoch by epoch, through pseudorandom permutations of its block numbers; slots and
blocks join by number.

The draw: all slots are numbered, source after source, and a pseudorandom
permutation of these numbers gives each its shard and place. So a slot's shard,
epoch and block follow from its number alone, and slots are made in as many tasks
as there are. What a source is due is exact: the place of its last block, which is
partly empty, in a permutation follows from the inverse permutation, so the number
of slots that hold the target (rounded), and what the last of them still takes,
are known in closed form.

Hot sources: sizes sum to offsets in two levels, over hashed parts of a source,
then over the parts' totals; slots and blocks join on (source, number).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, Scratch, let, packed, small, unpacked

#: Words a block, slots a shard, how often a word may be taken, weights in the order of sources, rounds of a permutation.
BLOCK, SHARD, MOST, WEIGHTS, ROUNDS = 64, 4096, 3, (1, 2, 3), 4
#: Rows of a part of a source (parts grow with the rows), slots of a task that makes them, ranges of slots that are dealt out at most.
PART_ROWS, TASK_SLOTS, RANGES = 50_000, 100_000, 100_000


def targets(sources: DataFrame, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds ``target`` to (source, source_size), a row a source.

    Shares follow the weights in code-point order of the sources, null last. A
    target stops at ``most`` times its source's size; the excess goes to the
    others by weight until none is above. In the order of most * size / weight
    the capped sources come first, so one pass over the sources finds them.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    everyone = W.partitionBy()
    by = W.orderBy(F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everyone) - F.coalesce(F.sum("__cap").over(before), F.lit(0))) / (F.sum("__w").over(everyone) - F.coalesce(F.sum("__w").over(before), F.lit(0.0)))
    rows = sources.withColumn("__w", weight).withColumn("__cap", most * F.col("source_size")).withColumn("__level", level)
    # the level of the first source whose cap it does not reach holds for all that come after it
    first = F.min(F.when(F.col("__cap") >= F.col("__level") * F.col("__w"), F.struct("__n", "__level"))).over(everyone)
    rows = rows.withColumn("__n", F.row_number().over(by)).withColumn("__level", first["__level"])
    share = F.least(F.col("__cap").cast("double"), F.coalesce(F.col("__level"), F.lit(float("inf"))) * F.col("__w"))
    return rows.withColumn("target", F.when(F.sum("source_size").over(everyone) > 0, share).otherwise(F.lit(0.0))).drop("__w", "__cap", "__level", "__n")


def permuted(df: DataFrame, name: str, x: str, n: str, keys: str, inverse: bool = False) -> DataFrame:
    """Adds ``name``: a pseudorandom permutation of 0..n-1 at ``x``, or its inverse: Feistel rounds over a mixed-radix square that just holds n, walked back into range.

    ``x``, ``n`` and ``keys`` are SQL. A round is a column, which the next ones name
    instead of repeating it. To be written before it is joined or filtered: the
    planner follows each column through all rounds.
    """
    steps = []  # (half that changes, the other, its modulus)
    for k in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
        two = [("lft", "rgt", "wide", k), ("rgt", "lft", "high", -1 - k)]
        steps += two[::-1] if inverse else two
    sign = "-" if inverse else "+"
    rounds = [(half, f"pmod({half} {sign} pmod(xxhash64({k}, {other}, {keys}), {m}), {m})") for half, other, m, k in steps]
    df = df.withColumns({"many": F.expr(f"cast({n} as bigint)"), "at_": F.expr(f"cast({x} as bigint)")}).withColumn("wide", F.expr("greatest(1L, cast(ceil(sqrt(cast(many as double))) as bigint))"))
    df = df.withColumn("high", F.expr("greatest(1L, cast(ceil(many / wide) as bigint))")).withColumns({"lft": F.expr("at_ div high"), "rgt": F.expr("pmod(at_, high)")})
    for half, step in rounds:
        df = df.withColumn(half, F.expr(step))
    once = "lft * high + rgt"
    for half, step in reversed(rounds):
        once = let(step, half, once)
    once = let("acc div high", "lft", let("pmod(acc, high)", "rgt", once))
    # the places beyond n are fewer than the square is wide: a walk longer than 64 steps would need as many of them in a row
    walk = f"pmod(aggregate(sequence(1, 64), spot_, (acc, i) -> if(acc < many, acc, {once})), many)"
    df = df.withColumn("spot_", F.expr("lft * high + rgt")).withColumn(name, F.expr(f"if(spot_ < many, spot_, {walk})"))
    return df.drop("many", "at_", "wide", "high", "lft", "rgt", "spot_")


def offsets(rows: DataFrame, spread: int) -> DataFrame:
    """Adds ``offset``, where a row's words begin in its source's stream; (doc, copy, source, size) rows, (doc, copy) distinct."""
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc", "copy"), F.lit(spread)))
    totals = rows.groupBy("source", "part").agg(F.sum("size").alias("n"))
    ahead = totals.withColumn("ahead", F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ahead = ahead.select(F.col("source").alias("s"), F.col("part").alias("p"), "ahead")
    inside = F.coalesce(F.sum("size").over(W.partitionBy("source", "part").orderBy("doc", "copy").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("inside", inside).join(small(ahead), F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).withColumn("offset", F.col("ahead") + F.col("inside")).drop("s", "p", "part", "ahead", "inside")


def due(rows: DataFrame, seed: int = 1, block: int = BLOCK) -> DataFrame:
    """A row a source of (source, size) rows: source, source_size, target, blocks, slots (how many it is due), last (words that its last slot takes), base (the number of its first slot)."""
    sized = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    out = sized.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long")).withColumn("want", F.round("target").cast("long"))
    out = out.withColumn("epoch", F.expr("if(want > 0, want div source_size, 0)")).withColumn("rest", F.expr("if(want > 0, want % source_size, 0)"))
    # the partly empty block: how many words it lacks, and which slot of the last epoch it is
    out = out.withColumn("lacks", F.col("blocks") * block - F.col("source_size"))
    out = permuted(out, "at", "greatest(blocks - 1, 0)", "greatest(blocks, 1)", f"{seed}, source, cast(epoch as int)", inverse=True)
    m = F.expr(f"if(rest = 0, 0, if(at >= ceil(rest / {block}), ceil(rest / {block}), ceil((rest + lacks) / {block})))").cast("long")
    out = out.withColumn("m", m).withColumn("slots", F.expr("epoch * blocks + m"))
    out = out.withColumn("last", F.expr(f"if(rest = 0, {block}, rest - (m - 1) * {block} + if(at < m - 1, lacks, 0))"))
    # one row a source, as the weights go by the sources' order
    base = F.coalesce(F.sum("slots").over(W.orderBy(F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return out.withColumn("base", base).select("source", "source_size", "target", "blocks", "slots", "last", "base")


def slots(sources: DataFrame, seed: int = 1, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """A row a slot of the mix: shard, place (in the shard), source, epoch, b (the block's number), take (words of it that are taken at most)."""
    every = sources.agg(F.sum("slots")).first()[0] or 0
    step, tasks = max(shard, -(-every // RANGES)), min(20_000, max(8, every // TASK_SLOTS))
    ranges = sources.where("slots > 0").withColumn("lo", F.explode(F.expr(f"sequence(0, slots - 1, {step})"))).repartition(tasks, "source", "lo")
    rows = ranges.select("*", F.explode(F.expr(f"sequence(lo, least(lo + {step}, slots) - 1)")).alias("j")).withColumn("epoch", F.expr("j div blocks"))
    rows = permuted(rows, "b", "j % blocks", "blocks", f"{seed}, source, cast(epoch as int)")
    rows = permuted(rows, "spot", "base + j", str(max(1, every)), str(seed))
    return rows.select(F.expr(f"spot div {shard}").alias("shard"), F.expr(f"spot % {shard}").alias("place"), "source", F.col("epoch").cast("int").alias("epoch"), "b", F.expr(f"if(j = slots - 1, last, {block})").cast("long").alias("take"))


def parts(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The parts of documents in each block of (doc, copy, source, size) rows: doc, copy, size, source, b, into (where it begins in the block), first, n (the words of the document)."""
    n = rows.count()
    out = offsets(rows, max(64, n // PART_ROWS)).where("size > 0")
    out = out.select("doc", "copy", "source", "size", "offset", F.explode(F.expr(f"sequence(offset div {block}, (offset + size - 1) div {block})")).alias("b"))
    first = F.greatest(F.lit(0), F.col("b") * block - F.col("offset"))
    out = out.withColumn("first", first).withColumn("n", F.least(F.col("size"), (F.col("b") + 1) * block - F.col("offset")) - F.col("first"))
    return out.withColumn("into", F.greatest(F.lit(0), F.col("offset") - F.col("b") * block)).drop("offset")


def plan(rows: DataFrame, scratch: Scratch, seed: int = 1, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(sources, pieces) of rows (doc, copy, source, size).

    pieces: doc, copy, epochs (a bit each), first, n: the words first..first+n-1 of a
    document are taken in those epochs.
    """
    sources = scratch.table(due(rows, seed, block), "sources")
    taken = scratch.table(slots(sources, seed, block), "slots", "snappy").groupBy(F.col("source").alias("s"), F.col("b").alias("__b"), "take").agg(F.sum(F.expr("shiftleft(1, epoch)")).alias("epochs"))
    # the planner takes what is exploded from a few sources for small: both sides grow with the input and are to be shuffled
    met = parts(rows, block).join(taken.hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("b") == F.col("__b")))
    return sources, met.withColumn("n", F.least(F.col("n"), F.col("take") - F.col("into"))).where("n > 0").select("doc", "copy", "epochs", "first", "n")


#: A document's key: its id, source, size and text. Rows with one key are copies, told apart by a number.
_KEY = "struct(coalesce({i}, 0) as i, {i} is null as none, {s} as source, {n} as size, xxhash64({t}) as h)"
_SIZE = f"coalesce(regexp_count({{t}}, r'{WORD}'), 0)"


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc, n: the number of copies of each key. Copies combine before they meet."""
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(source_col).cast("string").alias("s"), F.col(text_col).alias("t")).withColumn("n", F.expr(_SIZE.format(t="t")).cast("long"))
    return rows.select(F.expr(_KEY.format(i="i", s="s", n="n", t="t")).alias("doc")).groupBy("doc").agg(F.count(F.lit(1)).alias("n"))


def _numbered(sizes: DataFrame) -> DataFrame:
    """A row for each copy: doc, copy (from 1), source, size."""
    return sizes.select("doc", F.explode(F.expr("sequence(1, n)")).alias("copy"), F.col("doc.source").alias("source"), F.col("doc.size").alias("size"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 1) -> DataFrame:
    """doc_id, size, source_size, target, taken: what the mix takes of each document, repeats counted.

    A row for each row of ``docs``; rows that repeat are taken one by one. Null
    texts have size 0; the null source is a source; an empty table gives an
    empty table; all sizes zero give targets of zero; other columns are not
    looked at.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    rows = scratch.table(_numbered(_sizes(docs, id_col, text_col, source_col)), "sizes")
    sources, pieces = plan(rows, scratch, seed)
    taken = pieces.groupBy("doc", "copy").agg(F.sum(F.col("n") * F.bit_count("epochs")).alias("taken"))
    per = rows.join(taken.hint("merge"), ["doc", "copy"], "left").join(small(sources.select(F.col("source").alias("s"), "source_size", "target")), F.col("source").eqNullSafe(F.col("s")))
    return per.select(F.when(~F.col("doc.none"), F.col("doc.i")).alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The documents as mixed: the columns of ``docs`` with ``text`` (and ``n_chars``) rewritten to what is taken, as ``mix`` says.

    A document taken whole in an epoch gives its text unchanged; one taken in
    part gives the words taken, in order, with single spaces. The epochs of a
    document follow each other, a line each. Documents of which nothing is taken
    go; so do texts without words, null ones included (they have nothing to take).
    Rows that repeat are taken one by one; columns of any other name pass through;
    an empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "mixdocs")
    rows = scratch.table(_numbered(_sizes(docs, "doc_id", "text", "source")), "sizes")
    _, pieces = plan(rows, scratch, seed)
    per = pieces.withColumn("epoch", F.explode(F.filter(F.sequence(F.lit(0), F.lit(MOST - 1)), lambda e: F.getbit(F.col("epochs"), e) > 0)))
    per = per.groupBy("doc", "copy", "epoch").agg(F.sum("n").alias("words"), F.array_sort(F.collect_list(F.struct("first", "n"))).alias("parts"))
    per = per.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("copy", "epoch", "words", "parts"))).alias("epochs"))
    keyed = packed(docs).withColumn("doc", F.expr(_KEY.format(i="cast(row.doc_id as bigint)", s="cast(row.source as string)", n=f"cast({_SIZE.format(t='row.text')} as bigint)", t="row.text")))
    # copies are alike, so any order among them will do; the join has sorted them by this key already
    met = keyed.join(per.hint("merge"), "doc").withColumn("copy", F.row_number().over(W.partitionBy("doc").orderBy("doc")))
    met = met.withColumn("mine", F.expr("filter(epochs, e -> e.copy = copy)")).where("size(mine) > 0")
    met = met.withColumn("words", F.expr(rf"if(exists(mine, e -> e.words < doc.size), regexp_extract_all(row.text, r'{WORD}', 0), cast(null as array<string>))"))
    line = "if(e.words = doc.size, row.text, array_join(flatten(transform(e.parts, p -> slice(words, cast(p.first + 1 as int), cast(p.n as int)))), ' '))"
    out = met.withColumn("new", F.expr(f"array_join(transform(mine, e -> {line}), '\\n')"))
    changed = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.char_length("new").cast("long")
    return unpacked(out, docs, changed)


def mixed_blocks(docs: DataFrame, seed: int = 1) -> DataFrame:
    """shard, place, source, text: the mix itself, a row a slot: the words of its block that it takes, with single spaces.

    Of an empty table, or texts without words, there are none.
    """
    scratch = Scratch(docs.sparkSession, "mixblocks")
    rows = scratch.table(_numbered(_sizes(docs, "doc_id", "text", "source")), "sizes")
    sources = scratch.table(due(rows, seed), "sources")
    # a copy's words are those of the key's text: any row of the key will do
    text = docs.select(F.expr(_KEY.format(i="cast(doc_id as bigint)", s="cast(source as string)", n=f"cast({_SIZE.format(t='text')} as bigint)", t="text")).alias("doc"), "text").groupBy("doc").agg(F.any_value("text").alias("text"))
    cut = parts(rows).groupBy("doc").agg(F.collect_list(F.struct("b", "into", "first", "n")).alias("parts")).join(text, "doc").withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    pieces = cut.select(F.col("doc.source").alias("source"), "words", F.explode("parts").alias("p")).select("source", F.col("p.b").alias("b"), F.col("p.into").alias("into"), F.expr("slice(words, cast(p.first + 1 as int), cast(p.n as int))").alias("words"))
    blocks = pieces.groupBy(F.col("source").alias("s"), F.col("b").alias("__b")).agg(F.expr("flatten(transform(array_sort(collect_list(struct(into, words))), x -> x.words))").alias("words"))
    met = scratch.table(slots(sources, seed), "slots", "snappy").join(blocks.hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("b") == F.col("__b")))
    return met.select("shard", "place", "source", F.expr("array_join(slice(words, 1, cast(take as int)), ' ')").alias("text"))
