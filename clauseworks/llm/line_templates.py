"""Operator 10, line dedup: a log-template tree in DataFrame functions only.

Lines are parsed by a tree of fixed depth: their number of tokens, then their leading tokens; tokens
with digits are variable fields. Within a leaf, lines that agree with the leaf's commonest line in
enough of the other positions share its template (the positions that differ become variable); the
lines that are left share templates of further seeds, until no two that are left agree. A
template that recurs across documents is kept in the document of least id and dropped elsewhere.
Short lines and lines of mostly variable fields are their own templates: only equal ones recur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseworks.llm._streams import free_name
from clauseworks.runtime import discard, materialize

#: Depth of leading tokens, least tokens of a line that is generalised, and least share of agreeing tokens after the leading ones.
LEADING, LEAST_TOKENS, AGREE = 3, 5, 0.6
#: A token with a digit is a variable field.
VARIABLE = r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*"
#: What a line has that isn't blank.
VISIBLE = r"[^\s\p{Z}]"
#: A list of leaves up to this many rows is broadcast; of a longer one 64 bits in each of so many words are, and what passes is joined by shuffle.
BROADCAST_ROWS = 200_000
#: Rows of blocks from which on the rounds go on in one task each: a shuffle takes longer than such a round.
ROWS_AT_ONCE = 20_000
#: A line with more than this share of all lines is hot; there are at most HOT_SHARE of them, and they are broadcast.
HOT_SHARE = 5000


def parsed_lines(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """(doc, at, pos, leaf, own, line): the lines that aren't blank, masked, with hashes of leaf and line.

    Lines of fewer than LEAST_TOKENS tokens or mostly of variable fields aren't masked, and each has a
    leaf of its own, so that only equal lines are copies; they have a null for line. What is said of a line more
    than once is a column, so that it is computed once.
    """
    lines = docs.select(F.col(ident).alias("doc"), F.xxhash64(text).alias("at"), F.posexplode(F.split(text, "\n")).alias("pos", "raw")).where("doc is not null")
    raw, tokens, variable = F.col("raw"), F.col("tokens"), F.col("variable")
    spaces = F.octet_length(raw) - F.octet_length(F.replace(raw, F.lit(" ")))
    lines = lines.where(raw.rlike(VISIBLE)).withColumns({"tokens": spaces + 1, "variable": raw.rlike("[0-9]")})
    lines = lines.withColumn("general", (tokens >= LEAST_TOKENS) & (~variable | (F.regexp_count(raw, F.lit(VARIABLE)) * 2 <= tokens)))
    lines = lines.withColumn("line", F.when(F.col("general"), F.when(variable, F.regexp_replace(raw, VARIABLE, "<*>")).otherwise(raw)))
    leaf = F.when(F.col("general"), F.xxhash64(tokens, F.substring_index("line", " ", LEADING))).otherwise(F.xxhash64(F.lit(-1), raw))
    return lines.select("doc", "at", "pos", leaf.alias("leaf"), F.xxhash64(F.coalesce("line", raw)).alias("own"), "line")


def agreeing(line: str, seed: str) -> Column:
    """Whether two lines of a leaf agree in enough of the positions after the leading ones."""
    words, seed_words = F.split(line, " "), F.split(seed, " ")
    equal = F.aggregate(F.zip_with(words, seed_words, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda a, x: a + x)
    lead = F.least(F.size(words), F.lit(LEADING))
    return (equal - lead) >= AGREE * (F.size(words) - lead)


def further_templates(left: DataFrame) -> DataFrame:
    """(leaf, own, template): templates among the variants (leaf, own, n, line) that don't agree with their leaf's seed.

    Lines that may differ in d positions are cut into d + 1 blocks of positions: two that agree have
    an equal block. Each round takes as seeds the lines that are commonest (ties: of greatest hash) in
    all blocks that they share with others, and gives each line that agrees with some of them to the
    commonest. Seeds and their lines leave; the rounds end when no two of the others share a block.
    So any number of templates of a leaf are found at once, and no pairs but those with a seed are made.
    """
    leaves = left.groupBy("leaf").agg(F.count("*").alias("variants")).where("variants > 1").select("leaf")
    left = materialize(left.join(leaves, "leaf", "left_semi").select("leaf", "own", "n", "line"), "left")
    words = F.split("line", " ")
    left_words = left.select("leaf", "own", "n", F.slice(words, F.lit(LEADING + 1), F.size(words)).alias("words")).withColumn("m", F.size("words")).where("m > 0")
    n_blocks = (F.col("m") - F.ceil(F.col("m") * AGREE - 1e-9) + 1).cast("int")
    cut = lambda j: F.floor(j * F.col("m") / F.col("n_blocks")).cast("int")
    block = F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda j: F.xxhash64("leaf", j, F.slice("words", cut(j) + 1, cut(j + 1) - cut(j))))
    blocks = materialize(left_words.withColumn("n_blocks", n_blocks).select("leaf", "own", "n", F.explode(block).alias("block")), "blocks")
    found = left.select("leaf", "own", F.col("own").alias("template")).where("false")
    few = False
    one = lambda df: df.coalesce(1) if few else df  # noqa: E731  tables of one part are joined where they are; Spark has to be told again after each join
    side = lambda df: one(df).hint("merge") if few else df
    while True:
        tops = blocks.groupBy("block").agg(F.max(F.struct("n", "own")).alias("top"), F.count("*").alias("sharing")).where("sharing > 1")
        near = materialize(blocks.join(side(tops.drop("sharing")), "block"), "near")
        if not few:
            discard(blocks)
        rows = near.count()
        if not rows:
            discard(near)
            return found
        if not few and rows <= ROWS_AT_ONCE:
            few = True
            left = materialize(left.join(near.select("leaf", "own").distinct(), ["leaf", "own"], "left_semi"), "left")
        near = one(near)
        seeds = near.groupBy("leaf", "own").agg(F.bool_and(F.col("top.own") == F.col("own")).alias("seed")).where("seed").select("leaf", F.col("own").alias("template"))
        seeds = seeds if few else materialize(seeds, "seeds")
        pairs = near.where("top.own <> own").select("leaf", "own", F.col("top.n").alias("n"), F.col("top.own").alias("template")).distinct()
        pairs = one(one(pairs).join(side(seeds), ["leaf", "template"], "left_semi"))
        pairs = one(pairs.join(side(left.select("leaf", "own", "line")), ["leaf", "own"]))
        pairs = one(pairs.join(side(left.select("leaf", F.col("own").alias("template"), F.col("line").alias("seed"))), ["leaf", "template"]))
        joined = pairs.where(agreeing("line", "seed")).groupBy("leaf", "own").agg(F.max_by("template", F.struct("n", "template")).alias("template"))
        settled = materialize(one(joined.unionByName(seeds.select("leaf", F.col("template").alias("own"), "template"))), "settled")
        found = found.unionByName(settled)
        blocks = one(near.drop("top").join(side(settled), ["leaf", "own"], "left_anti"))
        if not few:
            blocks = materialize(blocks, "blocks")
            discard(near)


def in_leaves(lines: DataFrame, leaves: DataFrame) -> DataFrame:
    """The lines of the given leaves (a row each). Many leaves are no longer broadcast; a bit of a fixed number is, for each, so that few other lines are shuffled with their texts."""
    if leaves.count() <= BROADCAST_ROWS:
        return lines.join(F.broadcast(leaves), "leaf", "left_semi")
    word = lambda: F.pmod(F.shiftright("leaf", 6), F.lit(BROADCAST_ROWS)).alias("word")
    bit = F.expr("shiftleft(1L, cast(leaf & 63 as int))")
    words = leaves.groupBy(word()).agg(F.bit_or(bit).alias("bits"))
    passed = lines.withColumn("word", word()).join(F.broadcast(words), "word").where(F.col("bits").bitwiseAND(bit) != 0)
    return passed.drop("word", "bits").join(leaves, "leaf", "left_semi")


def dropped_lines(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, at, positions): the line numbers (from 0) to drop of each document that loses lines."""
    lines = materialize(parsed_lines(docs, ident, text), "lines")
    seen = lines.drop("line")
    stats = seen.groupBy("leaf", "own").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("n"))
    stats = materialize(stats, "line-stats")

    leaves = materialize(stats.groupBy("leaf").agg(F.count("*").alias("variants")).where("variants > 1").select("leaf"), "leaves")
    variants = in_leaves(lines.select("leaf", "own", "line").where("line is not null"), leaves).groupBy("leaf", "own").agg(F.min("line").alias("line"))
    variants = materialize(variants.join(stats, ["leaf", "own"]), "variants")
    seeds = variants.groupBy("leaf").agg(F.max_by("line", F.struct("n", "line")).alias("seed"))
    matched = variants.join(seeds, "leaf").where(agreeing("line", "seed"))
    matched = materialize(matched.select("leaf", "own", F.xxhash64("seed").alias("template")), "matched")
    more = further_templates(variants.join(matched, ["leaf", "own"], "left_anti"))
    alike = matched.unionByName(more).join(variants.select("leaf", "own", "first", "last"), ["leaf", "own"])
    template = alike.groupBy("leaf", "template").agg(F.min("first").alias("t_first"), F.max("last").alias("t_last"))
    general = alike.select("leaf", "own", "template").join(template, ["leaf", "template"]).drop("template")

    every = stats.select("leaf", "own", "first", "last").join(general, ["leaf", "own"], "left")
    every = every.select("leaf", "own", F.coalesce("t_first", "first").alias("keeper"), F.coalesce("t_last", "last").alias("end"))
    # a hot line would meet in one task, so the few hot ones are broadcast and the others are joined by shuffle
    recurring = materialize(every.where("keeper <> end").drop("end").join(stats.select("leaf", "own", "n"), ["leaf", "own"]), "recurring")
    least = (stats.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // HOT_SHARE
    hot = F.broadcast(recurring.where(F.col("n") > least).drop("n"))
    others = seen.join(hot.select("leaf", "own"), ["leaf", "own"], "left_anti").join(recurring.where(F.col("n") <= least).drop("n"), ["leaf", "own"])
    gone = seen.join(hot, ["leaf", "own"]).unionByName(others).where("doc <> keeper")
    return gone.groupBy("doc", "at").agg(F.collect_set("pos").alias("positions"))


def dedup_lines(docs: DataFrame, ident: str = "doc_id", text: str = "text", n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """docs' columns with the text less its dropped lines, plus n_lines and n_dropped (longs).

    A line is what stands between newlines. Lines of fewer than LEAST_TOKENS tokens and lines that
    are mostly variable fields have exact copies only; blank lines are never dropped. Repeats inside one document stay. Exact and
    generalised copies are dropped in all documents but the one of least id (a tie of ids is one
    document). A null text stays null with 0 lines; an empty text has one empty line; rows with a
    null id are left as they are. Columns of docs with the names given for n_lines and n_dropped,
    whatever their case, are replaced. Lines are equal if their 64-bit hashes within a leaf are, and leaves if theirs are. The
    positions of a document are at most its lines, so no group is unbounded.
    """
    kept = docs.drop(n_lines, n_dropped)
    doc, at, positions = (free_name(docs, name) for name in ("doc_of", "text_hash", "positions"))
    gone = dropped_lines(docs, ident, text).withColumnsRenamed({"doc": doc, "at": at, "positions": positions})
    lines = F.split(F.col(text), "\n")
    joined = kept.join(gone, (kept[ident] == gone[doc]) & (F.xxhash64(kept[text]) == gone[at]), "left")
    rest = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(positions, i)), "\n")
    joined = joined.withColumn(n_lines, F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long"))
    joined = joined.withColumn(n_dropped, F.when(F.col(positions).isNull(), F.lit(0)).otherwise(F.size(positions)).cast("long"))
    return joined.withColumn(text, F.when(F.col(positions).isNull(), F.col(text)).otherwise(rest)).drop(doc, at, positions)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents without the lines of templates that recur across documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "text")
