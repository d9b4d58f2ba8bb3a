"""Line dedup by an exact set-similarity join (prefix, length and positional filters), in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, read, set_aside, staged

#: Jaccard similarity of the sets of words, 4/5, in whole numbers: 9 * shared >= 4 * (words of one + words of the other).
#: Token frequencies are counted by hash, in so many counters.
COUNTERS = 1 << 16
_HASH_BITS = 48
#: Lines of more words have signatures of 128 bits, others of 64.
_LONG = 80


def _rare_spaces(text: Column) -> Column:
    """Whether words of the text may be parted by something else than blanks."""
    return F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\r")) | F.contains(text, F.lit("\x0b")) | F.contains(text, F.lit("\x0c"))


def _raw_words() -> Column:
    """Words of "line" and perhaps some empty ones. Where "rare" says so, rare spaces become blanks first, so that the quick split at one character will do."""
    return F.split(F.when(F.col("rare"), F.translate("line", "\t\r\x0b\x0c", "    ")).otherwise(F.col("line")), " ")


def words() -> Column:
    """The words of "line", each once, by 64-bit hashes: Spark compares arrays of numbers several times as fast as arrays of strings."""
    return F.array_remove(F.array_distinct(F.transform(_raw_words(), lambda t: F.xxhash64(t))), F.xxhash64(F.lit("")))


def split_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, no, line) of the lines with a word of docs (doc_id, text); text_key tells repeated rows of a doc_id apart."""
    keyed = docs.select("doc_id", _text_key(), "text")  # beside posexplode, the key would be worked out anew for each line
    lines = keyed.select("doc_id", "text_key", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return lines.where(F.btrim("line", F.lit(" \t\r\x0b\x0c")) != "")


def _text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")


def _numbers(values: list[int]) -> Column:
    """A list of numbers as one array literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def frequencies(lines: DataFrame) -> list[int]:
    """A rank by frequency for each counter: 1 plus eight times the binary logarithm of how often its tokens occur in all lines. COUNTERS rows at most go to the driver."""
    out = [0] * COUNTERS
    counters = lines.select(F.explode(_raw_words()).alias("t")).groupBy(F.xxhash64("t").bitwiseAND(F.lit(COUNTERS - 1)).cast("int").alias("counter"))
    for row in counters.agg((1 + F.floor(8 * F.log2(F.count("*")))).cast("int").alias("rank")).collect():
        out[row["counter"]] = row["rank"]
    return out


def with_keys(lines: DataFrame, ranks: list[int]) -> DataFrame:
    """lines with n (words) and k: the words as numbers in order of rarity, equal in all lines (rank, then 48 bits of the hash)."""
    table = _numbers(ranks)

    def key(t: Column) -> Column:
        h = F.xxhash64(t)
        rank = F.coalesce(table[h.bitwiseAND(F.lit(COUNTERS - 1))], F.lit(0).cast("long"))  # never null: Spark sorts such numbers as they are, others boxed
        return F.shiftleft(rank, _HASH_BITS).bitwiseOR(F.shiftrightunsigned(h, 64 - _HASH_BITS))

    k = F.sort_array(F.array_remove(F.array_distinct(F.transform(_raw_words(), key)), key(F.lit(""))))
    return lines.withColumn("k", k).withColumn("n", F.size("k"))  # a projection compiles what surrounds the lambda; explode(array(k)) would interpret it all


def prefixes(lines: DataFrame) -> DataFrame:
    """(tok, num, u, v, s1, s2): a row for each of the first n - ceil(4n/5) + 1 words of lines (num, n, k), in order of rarity.

    Of two similar sets, these prefixes share a word. v is 4n and u 5n less 9 times the word's place. The signature s1, s2
    holds, for 128 classes of words, whether their number is odd: it differs in no more bits than the sets differ in words.
    Up to _LONG words, s1 holds the two halves in one and s2 is zero.
    """
    bit = [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    parities = lambda t: F.aggregate("k", F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(_numbers(t)[x.bitwiseAND(F.lit(127))]))
    short = F.col("n") <= _LONG
    s1 = F.when(short, parities(bit + bit)).otherwise(parities(bit + [0] * 64))
    s2 = F.when(short, F.lit(0).cast("long")).otherwise(parities([0] * 64 + bit))
    cut = lines.select("num", "n", F.slice("k", 1, F.expr("n - (4 * n + 4) div 5 + 1").cast("int")).alias("prefix"), s1.alias("s1"), s2.alias("s2"))
    cut = cut.select("num", "n", "s1", "s2", F.posexplode_outer("prefix").alias("pos", "tok"))  # no prefix is empty; but for "outer", Spark works each out twice, to see that
    number = lambda x, kind: F.coalesce(F.expr(x), F.lit(0)).cast(kind)
    return cut.select("tok", "num", number("5 * n - 9 * pos", "int").alias("u"), number("4 * n", "int").alias("v"), number("s1", "long").alias("s1"), number("s2", "long").alias("s2"))


def plausible(a: str, b: str) -> Column:
    """Whether rows with a shared prefix word pass the length, positional and signature filters.

    With l words from the shared one on, at most min(l_a, l_b) are shared, so 9 * l >= 4 * (n_a + n_b) on both sides: u >= the
    other's v. As l <= n, this is never so for sets whose sizes alone forbid it. Both comparisons are one, of the sign that two
    differences have together: either alone comes out at random from pair to pair, which a processor can't foresee.
    """
    differ = f"if(({a}.v > {4 * _LONG}) = ({b}.v > {4 * _LONG}), bit_count({a}.s1 ^ {b}.s1) + bit_count({a}.s2 ^ {b}.s2), bit_count({a}.s1 ^ {a}.s2 ^ {b}.s1 ^ {b}.s2))"
    return F.expr(f"(({a}.u - {b}.v) | ({b}.u - {a}.v)) >= 0 AND {differ} <= ({a}.v + {b}.v) div 4 - 2 * (({a}.v + {b}.v + 8) div 9)")


def _similar(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Of pairs (z, w), the lines z whose words and those of w have a Jaccard similarity of at least 4/5; held has (num, words)."""
    side = lambda name: held.select(F.col("num").alias(name), F.col("words").alias(f"words_{name}"))
    both = pairs.join(side("z"), "z").join(side("w"), "w")
    return both.where(9 * F.size(F.array_intersect("words_z", "words_w")) >= 4 * (F.size("words_z") + F.size("words_w"))).select("z").distinct()


def distinct_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two staged tables: (num, doc_id, text_key, no), where each different line of docs occurs first, and (num, line, rare): rare if its text holds spaces other than blanks.

    num names the line and grows with doc_id (null first), text_key and no. Copies are told by a 128-bit hash and counted
    before any row moves; texts are read where the first copy stands.
    """
    order = ["doc_id", "text_key", "no"]
    firsts = split_lines(docs).groupBy(F.xxhash64("line"), F.xxhash64(F.lit("again"), "line")).agg(F.min(F.struct(*order)).alias("at")).select("at.*")
    # The number of a row is only sure once the sorted partitions are written.
    firsts = staged(firsts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("num", F.monotonically_increasing_id()), "line-firsts")
    # Both sides are grouped and joined by the same columns, of which none is null, so texts move once; and at any size alike.
    by = [F.struct("doc_id").alias("at"), "text_key"]
    wanted = firsts.groupBy(*by).agg(F.collect_list(F.struct("no", "num")).alias("wanted"))
    texts = docs.select("doc_id", _text_key(), "text").groupBy(*by).agg(F.first("text").alias("text"))
    held = texts.join(wanted.hint("merge"), ["at", "text_key"])
    held = held.select("wanted", "text", _rare_spaces(F.col("text")).alias("rare"))
    held = held.select("wanted", "rare", F.explode(F.array(F.split("text", "\n"))).alias("all"))  # explode keeps the split from being done at each use
    held = held.select(F.explode("wanted").alias("x"), "all", "rare").select("x.num", F.col("all")[F.col("x.no")].alias("line"), "rare")
    return firsts, staged(held, "line-texts")


def kept_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, no) of the lines with a word of docs (doc_id, text) that repeat no earlier one.

    Lines are in order of doc_id (null first), text_key and place. A line goes if any earlier line, kept or not, has the
    same text or a set of words with a Jaccard similarity of at least 4/5. Rows equal in doc_id and text count as one.
    """
    firsts, texts = distinct_lines(docs)
    # 1. Rows of six numbers meet by rare word. Those with any plausible partner stay, and none is doubled by a match: all plausible pairs are among them.
    rows = prefixes(with_keys(texts, frequencies(texts)))
    rows = staged(rows.alias("a").join(rows.alias("b"), (F.col("a.tok") == F.col("b.tok")) & plausible("a", "b") & (F.col("a.num") != F.col("b.num")), "left_semi"), "line-prefixes")
    chosen = rows.select("num").distinct()
    # Only numbers are held, and the texts need no sorting.
    held = staged(texts.join(chosen.hint("shuffle_hash"), "num", "left_semi").select("num", words().alias("words")), "line-held")
    discard(texts)
    # 2. Each line against the earliest one with the same rare word: most that go, go here, one pair a word.
    earliest = rows.groupBy("tok").agg(F.min(F.struct("num", "u", "v", "s1", "s2")).alias("w"), F.count("*").alias("c")).where("c > 1").select("tok", "w.*")
    met = (F.col("z.tok") == F.col("w.tok")) & (F.col("w.num") < F.col("z.num")) & plausible("z", "w")
    pairs = rows.alias("z").join(earliest.alias("w"), met).select(F.col("z.num").alias("z"), F.col("w.num").alias("w")).distinct()
    gone = staged(_similar(pairs, held), "line-gone")
    # 3. The rest against all earlier lines.
    rest = rows.join(gone, F.col("num") == F.col("z"), "left_anti")
    met = (F.col("a.tok") == F.col("b.tok")) & (F.col("b.num") < F.col("a.num")) & plausible("a", "b")
    pairs = rest.alias("a").join(rows.alias("b"), met).select(F.col("a.num").alias("z"), F.col("b.num").alias("w")).distinct()
    similar = gone.unionByName(_similar(pairs, held))
    return firsts.join(similar, F.col("num") == F.col("z"), "left_anti").select("doc_id", "text_key", "no")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, any others) without the lines that kept_lines leaves out, and __n_lines and __n_removed.

    Null texts stay null and have no lines. Lines without words stay. A text of which all lines go becomes empty, and an
    empty table stays empty. Other columns pass through; those by the added names are replaced.
    """
    docs, columns = set_aside(docs.drop("__n_lines", "__n_removed"), "__nos", "__key", "__d", "__t", "__lines", "__places")
    kept = kept_lines(docs.select("doc_id", "text")).groupBy("doc_id", "text_key").agg(F.collect_set("no").alias("__nos")).toDF("__d", "__t", "__nos")
    keyed = docs.withColumn("__key", _text_key())
    # Numbers of lines, a small part of the texts, are held; the texts need no sorting.
    joined = keyed.join(kept.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__key") == F.col("__t")), "left").drop("__d", "__t", "__key")
    joined = joined.withColumn("__lines", F.explode(F.array(F.split("text", "\n"))))  # explode keeps the split from being done at each use
    blank = F.filter(F.transform("__lines", lambda x, i: F.when(F.btrim(x, F.lit(" \t\r\x0b\x0c")) == "", i)), lambda i: i.isNotNull())
    joined = joined.withColumn("__places", F.sort_array(F.array_union(blank, F.coalesce("__nos", F.array().cast("array<int>")))))
    size = lambda c: F.when(F.col("text").isNull(), 0).otherwise(F.size(c)).cast("long")
    joined = joined.withColumn("__n_lines", size("__lines")).withColumn("__n_removed", F.col("__n_lines") - size("__places"))
    left = F.array_join(F.transform("__places", lambda i: F.col("__lines")[i]), "\n")
    return joined.withColumn("text", F.when(F.col("__n_removed") > 0, left).otherwise(F.col("text"))).select(*columns, "__n_lines", "__n_removed")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), "text")
